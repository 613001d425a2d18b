"""Files that matter for a review: keyword scores, missing dependencies, sibling evidence and snippets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.text import any_of, bind, frame, holds, joined, lines_or_one, split_lines, texts
from siftmill.operators.running import running_sums

# The keywords of the score.
KEYWORDS = (
    "login", "auth", "session", "token", "jwt", "cookie", "localStorage", "sessionStorage", "userType", "role", "admin", "isAdmin",
    "requireAuth", "ProtectedRoute", "PrivateRoute", "navigate", "withCredentials", "Authorization", "innerHTML", "outerHTML",
    "insertAdjacentHTML", "document.write", "eval", "Function", "location", "document.URL", "postMessage", "input.value", "price",
    "amount", "status", "productId", "userId", "payment", "order", "auction",
)
AUTH_KEYS = ("requireAuth", "checkSession", "userInfo.userType", "userType", "role", "isAdmin", "ADMIN", "NAFAL", "navigate")
# The keywords of snippets, in the order in which they are sought.
SNIPPET_KEYS = (
    "userType", "role", "isAdmin", "ADMIN", "localStorage", "sessionStorage", "cookie", "innerHTML", "outerHTML", "insertAdjacentHTML",
    "document.write", "eval", "Function", "location", "document.URL", "postMessage", "input.value", "price", "amount", "status", "productId",
    "userId", "payment", "order", "auction", "axios", "fetch", "FormData",
)
MISSING = "../utils/sessionUtils"


def lowered(words: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(w.lower() for w in words)


def relevance(path: Column, content: Column) -> Column:
    """Two for each keyword in the path and one for each in the content, both in lower case; presence counts, not frequency."""
    found = lambda text: reduce(lambda a, b: a + b, [F.contains(text, F.lit(k)).cast("int") for k in lowered(KEYWORDS)])
    return found(path) * 2 + found(content)


def most_relevant(files: DataFrame, n: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """The n files with the largest scores over 0, ties by path; with ``by`` so many of each group."""
    low = files.withColumns({"_path": F.lower("path"), "_content": F.lower("content")})  # columns, so that each is lowered once
    scored = low.withColumn("score", relevance(F.col("_path"), F.col("_content"))).drop("_path", "_content")
    if not by:
        return scored.orderBy(F.desc("score"), "path").limit(n).where("score > 0")  # scores over 0 come first
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "path")
    return scored.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n").where("score > 0")


def dependency_marks() -> dict[str, Column]:
    """Whether a file asks for the dependency, and whether it has its name."""
    content = F.col("content")
    asks = holds(content, ("sessionUtils",)) & F.exists(split_lines(content), lambda x: any_of(x, ("requireAuth", "checkSession")) & F.contains(x, F.lit("sessionUtils")))
    return {"_asks": asks, "_there": F.contains(F.lower("path"), F.lit("sessionutils"))}


def storage_marks(low: Column | None = None) -> dict[str, Column]:
    """Whether a file reads storage, names a role and names an administrator; its content in lower case, where it is at hand, saves searches."""
    content = F.col("content")
    may = lambda *words: F.lit(True) if low is None else holds(low, words)
    return {
        "_reads": may("storage.getitem", "document.cookie") & content.rlike(r"(?i)(?=[sld])(?:(?:sessionStorage|localStorage)\.getItem\s*\(|document\.cookie)"),
        "_keys": may("usertype", "role", "isadmin") & content.rlike(r"(?i)(?=[uri])(?:userType|role|isAdmin)"),
        "_admin": may("admin", "nafal") & content.rlike(r"(?i)(?=[an])(?:ADMIN|NAFAL)"),
    }


def missing_dependencies(files: DataFrame) -> DataFrame:
    """The one dependency that is asked for on some line, if no file has its name; else no row."""
    asked, there = (files.where(F.col(k) if k in files.columns else mark).select(F.lit(MISSING).alias("dependency")).distinct() for k, mark in dependency_marks().items())
    return asked.join(there, "dependency", "left_anti")


#: After every character that a path goes on with.
LAST = "\U0010ffff"


def storage_evidence(primary: DataFrame, files: DataFrame) -> DataFrame:
    """For each primary path whether it and the files whose paths begin with its folder read storage, name a role and name an administrator.

    The folder is not ended by a slash, so src/a also takes in src/ab.  In the order of paths such files are one range: the flagged
    files and both ends of each folder's range are put into one order, and what lies between the ends is the difference of running
    sums there.  No file is repeated for the folders above it."""
    flags = tuple(storage_marks())
    told = lambda df: df if set(flags) <= set(df.columns) else df.withColumns(storage_marks())
    own = told(primary).select("path", F.regexp_extract("path", r"^(.*)/", 1).alias("folder"), *[F.col(k).alias(f"own{k}") for k in flags])
    folders = own.where("folder != ''").select("folder").distinct()
    flagged = told(files).where(reduce(lambda a, b: a | b, map(F.col, flags))).select(F.col("path").alias("at"), F.lit(1).alias("kind"), F.lit("").alias("folder"), *[F.col(k).cast("long").alias(k) for k in flags])
    end = lambda at, kind: folders.select(at.alias("at"), F.lit(kind).alias("kind"), "folder", *[F.lit(0).cast("long").alias(k) for k in flags])
    points = flagged.union(end(F.col("folder"), 0)).union(end(F.concat("folder", F.lit(LAST)), 2))
    sums = running_sums(points, [], [F.col("at"), F.col("kind")], {f"sum{k}": k for k in flags})
    ends = sums.where("kind != 1").groupBy("folder").agg(*[F.sum(F.when(F.col("kind") == 2, F.col(f"sum{k}")).otherwise(-F.col(f"sum{k}"))).alias(f"in{k}") for k in flags])
    both = reduce(lambda a, b: a & b, [F.col(f"own{k}") | (F.coalesce(F.col(f"in{k}"), F.lit(0)) > 0) for k in flags])
    return own.join(ends, "folder", "left").select("path", both.alias("evidence"))


def first_hit(content: Column, keys: tuple[str, ...], around: int = 4) -> Column:
    """The frame of the first line with one of the keys, in any case; without one the first 20 lines."""


    def first(lines: Column) -> Column:
        hits = F.filter(F.transform(lines, lambda x, i: F.when(any_of(F.lower(x), lowered(keys)), i)), lambda i: i.isNotNull())
        return bind(F.get(hits, F.lit(0)), lambda i: F.when(i.isNotNull(), frame(lines, i, around, around)).otherwise(top_lines(lines)))

    return bind(lines_or_one(content), first)


def top_lines(lines: Column, n: int = 20) -> Column:
    return F.struct(F.lit(1).alias("start_line"), F.least(F.size(lines), F.lit(n)).alias("end_line"), joined(F.slice(lines, 1, n)).alias("snippet"))


def keyword_snippets(files: DataFrame, keys: tuple[str, ...] = SNIPPET_KEYS, most: int = 5, around: int = 6) -> DataFrame:
    """Up to ``most`` different frames of each file, by key and then line; the first 20 lines of a file without a hit.

    Rows: path, start_line, end_line, keyword (null without a hit) and snippet."""
    names = F.array(*[F.struct(F.lit(k).alias("low"), F.lit(name).alias("name")) for k, name in zip(lowered(keys), keys, strict=True)])

    def of_file(lines: Column) -> Column:
        """Each step is bound, so that a file is split once and its keys are sought only in lines with a hit."""
        low = F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.lower(x).alias("line")))
        hits = F.filter(low, lambda x: any_of(x["line"], lowered(keys)))
        place = lambda i, k: F.struct(F.greatest(i - around, F.lit(0)).alias("first"), F.least(i + around, F.size(lines) - 1).alias("last"), k.alias("keyword"))
        by_key = bind(hits, lambda h: F.flatten(F.transform(names, lambda k: F.transform(F.filter(h, lambda x: F.contains(x["line"], k["low"])), lambda x: place(x["i"], k["name"])))))
        frames = lambda found: F.slice(F.array_distinct(F.transform(found, lambda f: F.struct(f["first"], f["last"]))), 1, most)
        named = lambda f, found: F.get(F.filter(found, lambda x: (x["first"] == f["first"]) & (x["last"] == f["last"])), F.lit(0))["keyword"]
        shown = lambda f, found: F.struct((f["first"] + 1).alias("start_line"), (f["last"] + 1).alias("end_line"), named(f, found).alias("keyword"), joined(F.slice(lines, f["first"] + 1, f["last"] - f["first"] + 1)).alias("snippet"))
        top = bind(top_lines(lines), lambda t: F.array(F.struct(t["start_line"], t["end_line"], F.lit(None).cast("string").alias("keyword"), t["snippet"])))
        return bind(by_key, lambda found: F.when(F.size(found) > 0, F.transform(frames(found), lambda f: shown(f, found))).otherwise(top))

    return files.select("path", F.explode(bind(lines_or_one(F.col("content")), of_file)).alias("f")).select("path", "f.*")
