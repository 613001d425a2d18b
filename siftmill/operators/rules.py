"""Rules over chunks: DOM sinks near external input, eval, and command execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.functions.text import any_of, bind, frame, holds, lines_or_one, short_hash
from siftmill.operators.filters import built_for_chunks

# Fixed values of the rules.
SOURCES = ("location.hash", "location.search", "document.URL", "document.location", "input.value", "URLSearchParams", "event.data", "window.name")
SINKS = ("innerhtml", "outerhtml", "insertadjacenthtml", "document.write")
FILE_SINKS = (*SINKS, "dangerouslysetinnerhtml")
HARMLESS = ("testelement.innerhtml", "innerhtml = ''", 'innerhtml = ""')
STATIC = r"""innerhtml\s*=\s*['"][^'"]*['"]\s*;?"""
COMMANDS = ("child_process.exec", "child_process.execSync", 'require("child_process").exec', "require('child_process').exec")

NO_LINES = "cast(array() as array<int>)"
#: type, severity, confidence, reason, cwe; the messages are ours, the codes are stable.
RULES = {
    "DOM XSS": ("high", "medium", "external input may reach an HTML sink", "CWE-79"),
    "Unsafe eval": ("high", "medium", "eval runs text as code", "CWE-95"),
    "Command Injection": ("critical", "low", "input may become part of a command", "CWE-78"),
}


REACH = 6


def first_flow(lines: Column, sinks: tuple[str, ...], sources: tuple[str, ...], any_case: bool) -> Column:
    """Index (from 0) of the first line with a sink, not given a static text, that has a source within six lines; null without one.

    One pass over the lines with a sink or a source, which remembers the last source and the sinks of the last six lines: each hit
    knows the nearest other one before it, and no frame of lines is made."""

    def mark(x: Column, i: Column) -> Column:
        low = F.lower(x)
        sink = any_of(low, sinks) & ~any_of(low, HARMLESS) & ~low.rlike(STATIC)
        return F.struct(i.alias("i"), sink.alias("sink"), any_of(low if any_case else x, tuple(k.lower() for k in sources) if any_case else sources).alias("source"))

    def step(acc: Column, x: Column) -> Column:
        open_ = F.concat(F.filter(acc["open"], lambda s: s >= x["i"] - REACH), F.when(x["sink"], F.array(x["i"])).otherwise(F.expr(NO_LINES)))
        source = F.when(x["source"], x["i"]).otherwise(acc["source"])
        told = F.when(x["source"], F.array_min(open_)).when(x["sink"] & (source >= x["i"] - REACH), x["i"])
        return F.struct(source.alias("source"), open_.alias("open"), F.least(acc["first"], told).alias("first"))

    none = F.lit(None).cast("int")
    start = F.struct(none.alias("source"), F.expr(NO_LINES).alias("open"), none.alias("first"))
    return F.aggregate(F.filter(F.transform(lines, mark), lambda x: x["sink"] | x["source"]), start, step, lambda acc: acc["first"])


def has_dom_flow(content: Column) -> Column:
    """Whether a source stands within six lines of a sink; sources count in their own case."""
    return any_of(content, SOURCES) & any_of(F.lower(content), SINKS) & first_flow(lines_or_one(content), SINKS, SOURCES, False).isNotNull()


def dom_flow(content: Column) -> Column:
    """The first frame (start_line, end_line, snippet) around a sink with a source in any case, or null."""
    first = bind(lines_or_one(content), lambda lines: bind(first_flow(lines, FILE_SINKS, SOURCES, True), lambda i: F.when(i.isNotNull(), frame(lines, i, REACH, REACH))))
    return F.when(any_of(F.lower(content), FILE_SINKS), first)


def may_hit(content: Column) -> Column:
    """Whether a file has the words that the rules over its chunks look for; without them none of its chunks has a finding."""
    return holds(content, ("eval(", "child_process")) | (holds(content, SOURCES) & holds(F.lower(content), SINKS))


def chunk_rules(path: Column, content: Column) -> Column:
    """Array of the types of the rules that hold, in the order of the rules."""
    hits = {
        "DOM XSS": has_dom_flow(content) & ~built_for_chunks(path, content),
        "Unsafe eval": F.contains(content, F.lit("eval(")),
        "Command Injection": any_of(content, COMMANDS),
    }
    return F.array_compact(F.array(*[F.when(hit, F.lit(kind)) for kind, hit in hits.items()]))


def analyze_chunks(chunks: DataFrame) -> DataFrame:
    """Findings of chunks whose content is not empty: id, type, severity, confidence, reason, cwe, place and snippet.

    A finding's number within its chunk is part of its id; a hit in the overlap of two chunks is reported for both."""
    rows = chunks.where("content != ''").select("path", "chunk_index", "start_line", "end_line", "chunk_hash", F.substring("content", 1, 300).alias("snippet"), F.posexplode(chunk_rules(F.col("path"), F.col("content"))).alias("occurrence", "type"))
    table = F.create_map(*[x for kind, (a, b, c, d) in RULES.items() for x in (F.lit(kind), F.struct(F.lit(a).alias("severity"), F.lit(b).alias("confidence"), F.lit(c).alias("reason"), F.lit(d).alias("cwe")))])
    rows = rows.withColumn("rule", table[F.col("type")]).select("*", "rule.*").drop("rule")
    seed = F.concat_ws("|", "path", "chunk_index", "type", "start_line", "end_line", "reason", F.substring("snippet", 1, 50), "occurrence", "chunk_hash")
    return rows.withColumn("id", short_hash(seed))
