"""Column functions over source text: lines, frames of lines, matches and names."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_END = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"
RARE_END = r"[\r\x0B\f\x1C\x1D\x1E\x85\u2028\u2029]"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"


def texts(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.expr("cast(array() as array<string>)")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it; a plain Column would be computed at each place."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))  # a second parameter of ``use`` would be given the place


def _parts(text: Column) -> Column:
    """What stands between line ends; most texts have no other end than a line feed, which is no pattern."""
    return F.when(text.rlike(RARE_END), F.split(text, LINE_END, -1)).otherwise(F.split(text, "\n", -1))


def split_lines(text: Column) -> Column:
    """Lines without their ends; an end at the very end of the text adds no line, and an empty text has none."""
    return bind(_parts(text), lambda parts: F.slice(parts, 1, F.size(parts) - (F.element_at(parts, -1) == "").cast("int")))


def lines_or_one(text: Column) -> Column:
    """Lines, and one empty line for an empty text."""
    return bind(_parts(text), lambda parts: F.slice(parts, 1, F.greatest(F.lit(1), F.size(parts) - (F.element_at(parts, -1) == "").cast("int"))))


def strip(text: Column) -> Column:
    """Without space at its ends, which only a text whose first and last letters are not plain ones can have."""
    plain = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(plain, text).otherwise(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Suffix of the file name with its dot, lower case; none for names that begin or end with their only dot."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words occurs, as plain text; letters that none begins with are passed over."""
    first = "".join(sorted({re.escape(w[0]) for w in words}))
    return text.rlike(rf"(?=[{first}])(?:{'|'.join(map(re.escape, words))})")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """``any_of`` for few short words: bytes are compared and no pattern is run."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def count_of(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def joined(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def frame(lines: Column, at: Column, before: int, after: int) -> Column:
    """Struct start, end (from 1, inclusive) and text of the lines around the line with the index ``at`` (from 0)."""
    first = F.greatest(at - before, F.lit(0))
    last = F.least(at + after, F.size(lines) - 1)
    return F.struct((first + 1).alias("start_line"), (last + 1).alias("end_line"), joined(F.slice(lines, first + 1, last - first + 1)).alias("snippet"))


def indexed(lines: Column) -> Column:
    """Array of structs: i (from 0) and line."""
    return F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("line")))


def matches(text: Column, pattern: str) -> Column:
    """Array of structs: start (from 0) and hit, of all matches from left to right."""
    return bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: _placed(text, pattern, hits))


def _placed(text: Column, pattern: str, hits: Column) -> Column:
    """``matches``; a single hit in a text of plain letters, as most are, is found by its place alone."""
    one = F.array(F.struct((F.regexp_instr(text, F.lit(pattern)) - 1).alias("start"), F.get(hits, F.lit(0)).alias("hit")))
    plain = F.octet_length(text) == F.length(text)
    return F.when((F.size(hits) == 1) & plain, one).otherwise(_all_placed(text, pattern, hits))


def _all_placed(text: Column, pattern: str, hits: Column) -> Column:
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,hit:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.length(x["gap"])
        return F.struct((first + F.length(x["hit"])).alias("at"), F.concat(acc["out"], F.array(F.struct(first.alias("start"), x["hit"].alias("hit")))).alias("out"))

    return F.aggregate(F.filter(pieces, lambda x: x["hit"].isNotNull()), start, step, lambda acc: acc["out"])


def extract_all(text: Column, pattern: str, group: int = 1, has: tuple[str, ...] = ()) -> Column:
    """The group of every match.  Every match has one of the words ``has``: texts without them are not searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(holds(text, has), found).otherwise(texts()) if has else found


def extract(text: Column, pattern: str, group: int = 1, has: tuple[str, ...] = ()) -> Column:
    """The group of the first match, or null; ``has`` as in ``extract_all``."""
    found = text.rlike(pattern)
    return F.when(holds(text, has) & found if has else found, F.regexp_extract(text, pattern, group))


def extract_filled(text: Column, pattern: str, group: int = 1, has: tuple[str, ...] = ()) -> Column:
    """``extract`` of a group that is never empty, which takes one search."""
    found = bind(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x))
    return F.when(holds(text, has), found) if has else found


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def escape_html(text: Column, quotes: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;"), ("'", "&#x27;")] if quotes else [])
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def first_or(values: Column, default: str) -> Column:
    return F.coalesce(F.get(values, F.lit(0)), F.lit(default))
