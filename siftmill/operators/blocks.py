"""Blocks of code around a line: enclosing functions, guards that return early, and branches on a role."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftmill.functions.text import IDENTIFIER, any_of, bind, count_of, indexed, joined, lines_or_one, texts

REACH = 120
# Headers of functions, in the order in which they are tried.
HEADERS = (rf"\basync\s+function\s+({IDENTIFIER})\s*\(", rf"\bfunction\s+({IDENTIFIER})\s*\(", rf"\bconst\s+({IDENTIFIER})\s*=\s*async\s*\([^)]*\)\s*=>\s*\{{", rf"\bconst\s+({IDENTIFIER})\s*=\s*\([^)]*\)\s*=>\s*\{{")
# Checked names, sorted, as they come out in this order.
CHECKED = ("amount", "code", "email", "orderid", "password", "price", "role", "status", "userid", "usertype")
GUARD = r"if\s*\(.*\)\s*return\b|if\s*\(.*\)\s*\{\s*return;?\s*\}"
# Marks of code that only shows a role, and the tiers of lines that decide by one.
SHOWS = ("getrolebadgecolor", "badge", "color", "notificationrole", "shouldshownotification", "알림 표시", "역할별 뱃지", "역할별 알림", "return ['admin'", "return ['nafal'", "return 'var(")
TIERS = (
    r"(requireauth|checkauthstatus)\s*\(",
    r"(userinfo\.(usertype|role)|user\?\.(usertype|role)|\brole\b|\bisadmin\b).*(===|!==|==|!=|>|<)",
    r"\bif\b[^{\n]*\b(usertype|role|isadmin)\b[^{\n]*\b(admin|nafal)\b",
    r"\bif\b[^{\n]*\b(admin|nafal)\b.*\bnavigate\s*\(",
    r"\bif\b[^{\n]*\b(admin|nafal)\b.*\breturn\b",
    r"(protectedroute|privateroute)",
    r"\bnavigate\s*\(",
)
# Without one of these words no tier is met.
TOLD = r"requireauth|checkauthstatus|usertype|role|admin|nafal|protectedroute|privateroute|navigate"
FLOWS = r"(requireauth|checkauthstatus)\s*\(|\bnavigate\s*\("


def _header(line: Column) -> Column:
    return reduce(lambda rest, p: F.when(line.rlike(p), F.regexp_extract(line, p, 1)).otherwise(rest), reversed(HEADERS), F.lit(None).cast("string"))


def _told_lines(files: DataFrame, guards: bool) -> DataFrame:
    """The lines that can bound a block and, with ``guards``, those that check a value and return early; no others leave their file.

    Columns: path, i (from 0), opens and closes (braces), name (of the function whose header stands there, or null) and watch (null
    but for guards).  Braces count only in files with a header."""
    headed, line = F.col("content").rlike("|".join(HEADERS)), F.col("line")
    leaves = line.rlike("(?i)return") & _leaves(F.lower(line)) if guards else F.lit(False)
    split = files.where(headed | F.col("content").rlike("(?i)return") if guards else headed)
    lines = split.select("path", headed.alias("headed"), F.posexplode(lines_or_one(F.col("content"))).alias("i", "line"))
    bounds = F.col("headed") & (line.rlike("[{}]") | line.rlike("|".join(HEADERS)))
    lines = lines.where(bounds | leaves)
    braces = lambda c: F.when(F.col("headed"), count_of(line, c)).otherwise(0)
    watch = F.when(leaves, _watch(F.lower(line))) if guards else F.lit(None).cast("array<string>")
    return lines.select("path", "i", braces("{").alias("opens"), braces("}").alias("closes"), F.when(F.col("headed"), _header(line)).alias("name"), watch.alias("watch"))


def _enclosing(files: DataFrame, calls: DataFrame, guards: bool = False) -> DataFrame:
    """The innermost function around each line (path, line from 1): path, line, block (a struct of name, start_line and end_line, or
    null) and guards (line and watch, up to 120 lines around the line).

    Headers are sought up to 120 lines above (REACH), and their braces have to close at or up to 120 lines below the line: at the
    nearest line that is no deeper than before the header.  So depths at the lines with braces are all that is needed.  These
    lines and the asked ones are shuffled and sorted once, by file; frames of lines bound what is held of a file, and a file is
    bounded itself (``EngineConfig.max_file_bytes``)."""
    asked = calls.select("path", (F.col("line") - 1).cast("int").alias("i"), F.lit(0).alias("opens"), F.lit(0).alias("closes"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("array<string>").alias("watch"), F.lit(True).alias("asked"))
    rows = _told_lines(files, guards).withColumn("asked", F.lit(False)).unionByName(asked).repartition("path")
    rows = rows.groupBy("path", "i").agg(*[F.max(c).alias(c) for c in ("opens", "closes", "name", "watch", "asked")])
    order = Window.partitionBy("path").orderBy("i")
    above, near = order.rowsBetween(Window.unboundedPreceding, 0), order.rangeBetween(-REACH, REACH)
    rows = rows.withColumns({"depth": F.sum(F.col("opens") - F.col("closes")).over(above).cast("int"), "opened": F.sum("opens").over(above).cast("int")})
    one = F.struct("i", "depth", "opened", (F.col("depth") - F.col("opens") + F.col("closes")).alias("before"), (F.col("opened") - F.col("opens")).alias("known"), "name")
    bounds = (F.col("opens") > 0) | (F.col("closes") > 0) | F.col("name").isNotNull()
    found = F.when(F.col("watch").isNotNull(), F.struct((F.col("i") + 1).alias("line"), "watch"))
    rows = rows.withColumns({"lines": F.collect_list(F.when(bounds, one)).over(near), **({"guards": F.collect_list(found).over(near)} if guards else {})}).where("asked")
    heads = F.filter("lines", lambda x: x["name"].isNotNull() & (x["i"] <= F.col("i")))
    closes = lambda x, h: (x["depth"] <= h["before"]) & (x["opened"] > h["known"])
    own = F.struct("depth", "opened")
    later = lambda h: F.array_min(F.transform(F.filter("lines", lambda x: (x["i"] > F.col("i")) & closes(x, h)), lambda x: x["i"]))
    ends = F.transform(heads, lambda h: F.struct(h["name"].alias("name"), (h["i"] + 1).alias("start_line"), (F.when(closes(own, h), F.col("i")).otherwise(later(h)) + 1).alias("end_line")))
    block = F.try_element_at(F.filter(ends, lambda h: h["end_line"].isNotNull()), F.lit(-1))
    return rows.select("path", (F.col("i") + 1).alias("line"), block.alias("block"), *(["guards"] if guards else []))


def function_blocks(files: DataFrame, calls: DataFrame) -> DataFrame:
    """The function around each call: path, line, name, start_line, end_line (null where there is none)."""
    return _enclosing(files, calls).select("path", "line", "block.name", "block.start_line", "block.end_line")


def all_guards(files: DataFrame) -> DataFrame:
    """Lines that check a value and return early, anywhere in the files: path, line and watch (the checked names)."""
    rows = files.where(F.col("content").rlike("(?i)return")).select("path", F.explode(bind(lines_or_one(F.col("content")), lambda lines: _guards(indexed(lines)))).alias("g"))
    return rows.select("path", "g.*")


def _leaves(low: Column) -> Column:
    """Whether a line in lower case checks a value and returns early."""
    says = F.contains(low, F.lit("return")) & any_of(low, ("alert(", "throw new error", "seterror"))
    return any_of(low, CHECKED) & (low.rlike(GUARD) | says)


def _watch(low: Column) -> Column:
    """The checked names that a line in lower case has."""
    return F.filter(texts(*CHECKED), lambda k: F.contains(low, k))


def _guards(lines: Column) -> Column:
    """Of lines (i, line) those that check a value and return early, as structs of line (from 1) and watch."""
    low = F.transform(lines, lambda x: F.struct((x["i"] + 1).alias("line"), F.lower(x["line"]).alias("low")))
    return F.transform(F.filter(low, lambda x: _leaves(x["low"])), lambda x: F.struct(x["line"].alias("line"), _watch(x["low"]).alias("watch")))


def guard_breakpoints(files: DataFrame, calls: DataFrame) -> DataFrame:
    """Lines around each call that check a value and return early: path, call_line, line and watch (the checked names).

    They are sought in the function around the call, else up to 80 lines around it."""
    first, last = F.coalesce("block.start_line", F.col("line") - 80), F.coalesce("block.end_line", F.col("line") + 80)
    around = _enclosing(files, calls, guards=True).select("path", F.col("line").alias("call_line"), first.alias("first"), last.alias("last"), "guards")
    met = F.filter("guards", lambda g: (g["line"] >= F.col("first")) & (g["line"] <= F.col("last")))
    return around.select("path", "call_line", F.explode(met).alias("g")).select("path", "call_line", "g.line", "g.watch")


def role_branches(files: DataFrame, keep: tuple[Column, ...] = ()) -> DataFrame:
    """path, the columns of ``keep``, start_line, end_line, snippet of the line that most likely decides by a role, six lines around it.

    Tiers are tried in order; imports and code that only shows a role do not count and are cut off at the edges; without a
    hit the first 20 lines.  Each step is a column of its own, so that no step is computed again for every line."""
    rows = files.select("path", F.struct(F.lit(0).alias("_"), *keep).alias("kept"), lines_or_one(F.col("content")).alias("lines"), F.lower("content").rlike(TOLD).alias("told"))
    rows = rows.withColumn("low", F.when(F.col("told"), F.transform("lines", lambda x: F.lower(x))).otherwise(texts()))
    # what shows a role stands within a line; only where it does are the lines around put together
    rows = rows.withColumn("shown", F.transform("low", lambda x: any_of(x, SHOWS)))
    first = lambda i: F.greatest(i - 3, F.lit(0))
    around = lambda c, i: F.slice(c, first(i) + 1, F.least(i + 3, F.size(c) - 1) - first(i) + 1)
    shows = F.transform("shown", lambda _, i: F.when(F.array_contains(around(F.col("shown"), i), True), ~joined(around(F.col("low"), i)).rlike(FLOWS)).otherwise(False))
    rows = rows.withColumn("shows", shows)
    tier = lambda x: F.when(x.rlike(TOLD), reduce(lambda rest, n: F.when(x.rlike(TIERS[n]), n).otherwise(rest), reversed(range(len(TIERS))), F.lit(None).cast("int")))
    rows = rows.withColumn("marked", F.transform(F.arrays_zip("low", "shows"), lambda m, i: F.struct(i.alias("i"), m["low"].rlike(r"^\s*import ").alias("imports"), m["shows"].alias("shows"), tier(m["low"]).alias("tier"))))
    hits = F.array_sort(F.transform(F.filter("marked", lambda m: m["tier"].isNotNull() & ~m["imports"] & ~m["shows"]), lambda m: F.struct(m["tier"], m["i"].alias("i"))))
    rows = rows.select("path", "kept", "lines", "marked", F.get(hits, F.lit(0))["i"].alias("hit"))
    start = F.array_min(F.transform(F.filter("marked", lambda m: (m["i"] >= F.col("hit") - 6) & (m["i"] <= F.col("hit")) & (~m["shows"] | (m["i"] == F.col("hit")))), lambda m: m["i"]))
    rows = rows.withColumn("start", start)
    inner = F.transform(F.filter("marked", lambda m: (m["i"] >= F.col("start")) & (m["i"] <= F.col("hit") + 6) & ~m["imports"]), lambda m: m["i"])
    rows = rows.withColumn("inner", inner)
    a, b = F.coalesce(F.array_min("inner"), F.lit(0)), F.coalesce(F.array_max("inner"), F.least(F.size("lines"), F.lit(20)) - 1)
    rows = rows.withColumns({"a": a, "b": b})
    a, b = F.col("a"), F.col("b")
    return rows.select("path", "kept.*", (a + 1).alias("start_line"), (b + 1).alias("end_line"), joined(F.slice("lines", a + 1, b - a + 1)).alias("snippet")).drop("_")
