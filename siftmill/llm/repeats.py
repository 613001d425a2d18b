"""Removal of repeated passages: every byte that a string of ``window`` bytes covers which also starts anywhere else.

Suffixes are sorted by difference covers, but only where they can repeat.  Each window chooses a place by what stands in it
(``anchors``), so equal windows, wherever they stand, choose equal places and meet under one name; the rest never meets.
Windows that choose the same place form a context.  Contexts that occur more than once are repeats as a whole.  The others
of a name go to one task, which sorts the suffixes of many names' contexts at once and compares adjacent prefixes.  Names with
too many contexts for that are split by ranges of the distance from a window's start to its place (``crowded_spans``).

Bitmaps drop most rows before they are shuffled.  They only ever let too much through, which exact joins behind them sort out,
so results do not depend on their size; where the keys would fill the largest bitmap there is none, and the joins do it all.
Hashes that stand for bytes have 128 bits, and so have the keys of rows: even 10 ** 13 of them hardly ever meet by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.tables import mark, release_one

from .anchors import chosen, named, NAME
from .common import materialise, slices
from .suffixes import repeated

#: Bitmaps have at most two to this power of bits (64 MB), and at least four for each key; up to two to BITMAP_BITS_EACH of them where there is room.
BITMAP_BITS = 29
BITMAP_BITS_EACH = 4
#: Contexts of one name that are sorted in memory; those of names with more meet by ranges of their windows.
GROUP = 2_500
#: Parts into which a range is cut.
FAN = 4
#: Bytes of contexts that are sorted at once; a sort takes about 100 bytes of memory for each.
POOL = 1 << 18


def bitmap(keys: DataFrame, column: str) -> np.ndarray | None:
    """A bitmap in which the bits of all keys are set, or None if there are too many keys for the largest; ``keys`` is a written table."""
    n = keys.count()
    if max(10, (4 * n).bit_length()) > BITMAP_BITS:
        return None
    bits = max(10, min(BITMAP_BITS, (n << BITMAP_BITS_EACH).bit_length()))
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = keys.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("bit"))
    got = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2 ** (BITMAP_BITS - 6) rows of 12 bytes
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(keys), dtype=bool)
    place = keys.astype(np.int64).view(np.uint64) >> np.uint64(64 - (len(bits) * 64).bit_length() + 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def short(k: bytes) -> int:
    """The first half of a row's key as a number."""
    return int.from_bytes(k[:8], "little", signed=True)


def shorts(k: pa.Array) -> np.ndarray:
    return np.array(list(map(short, k.to_pylist())), dtype=np.int64)


def halves(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(shorts(batch.column(0)))], names=["at"])


def mixed(k: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One number for a row and a place in it."""
    with np.errstate(over="ignore"):
        x = (k.view(np.uint64) ^ (start.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ x >> np.uint64(32)).view(np.int64)


def _raw(batch: pa.RecordBatch, place: int):
    for x in batch.column(place).to_pylist():
        yield (x or "").encode("utf-8", "replace")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def crowded_spans(rows: DataFrame, window: int) -> list[DataFrame]:
    """Tables of spans (k, start, length) of repeated windows among the contexts (k, start, place, bytes) of crowded names.

    Equal windows begin equally far before their chosen places.  For a range of such distances, contexts that share a
    window agree in the bytes common to all windows of the range, and contexts that agree in all bytes of these windows
    repeat each other throughout it.  The first go on in smaller ranges, and of the second one of each kind, for the rest to
    meet.  Every exchange is by a hash of bytes, so a name is spread over all tasks, and a round has few rows a context.
    """

    def split(batches):
        digest = xxhash.xxh3_128_digest
        for batch in slices(batches):
            out: tuple[list, ...] = ([], [], [], [], [])
            for n, (place, raw, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)):
                nearest, farthest, step = place - (len(raw) - window), place, -(-(high - low + 1) // FAN)
                for a in range(low, high + 1, step):
                    b = min(a + step - 1, high)
                    if b >= nearest and a <= farthest:
                        core = digest(raw[place - a : place + window - b], a)
                        full = digest(raw[place - b : place + window - a], a) if nearest <= a and b <= farthest else None
                        for column, x in zip(out, (n, a, b, core, full), strict=True):
                            column.append(x)
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(4)), *(pa.array(x, pa.int32()) for x in out[1:3]), *(pa.array(x, pa.binary()) for x in out[3:])], names=["k", "start", "place", "bytes", "low", "high", "core", "full"])

    spans = []
    width = window - NAME + 1
    rows = rows.select("k", "start", "place", "bytes", F.lit(0).alias("low"), F.lit(width - 1).alias("high"))
    while width > 1 and not rows.isEmpty():
        nodes = materialise(rows.mapInArrow(split, "k binary, start int, place int, bytes binary, low int, high int, core binary, full binary"), "ranges")
        shared = nodes.groupBy("core").agg(F.count("*").alias("m")).where("m > 1").select("core")
        equal = nodes.where("full is not null").groupBy("full").agg(F.count("*").alias("n"), F.min(F.struct("k", "start")).alias("one")).where("n > 1")
        alive = materialise(nodes.join(shared, "core", "left_semi").join(equal, "full", "left"), "alive")
        spans.append(alive.where("n is not null").select("k", (F.col("start") + F.col("place") - F.col("high")).cast("long").alias("start"), (F.col("high") - F.col("low") + window).cast("long").alias("length")))
        rows = alive.where("high > low and (n is null or (one.k = k and one.start = start))").select("k", "start", "place", "bytes", "low", "high")
        width = -(-width // FAN)
    return spans


def pools(batches, most: int | None = None):
    """Rows (k, start, bytes) of batches (name, k, start, bytes) sorted by name, whole names together while their bytes are not over ``most``
    (POOL): a larger name is a pool of its own.  Names with one row are left out."""
    most = POOL if most is None else most
    pool, size, own, own_size, last = [], 0, [], 0, None
    for row in (row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns), strict=True)):
        if row[0] != last:
            if len(own) > 1:
                if pool and size + own_size > most:
                    yield pool
                    pool, size = [], 0
                pool.extend(own)
                size += own_size
            last, own, own_size = row[0], [], 0
        own.append(row[1:])
        own_size += len(row[3])
    if len(own) > 1:
        if pool and size + own_size > most:
            yield pool
            pool = []
        pool.extend(own)
    if pool:
        yield pool


def spans_of(keyed: DataFrame, window: int, group: int = GROUP) -> DataFrame:
    """Spans of repeated windows of the rows (k binary, text string): k, and spans as an array of start << 32 | length.

    They are a written table, and what was written on the way to it is deleted."""
    spark = keyed.sparkSession
    before = mark(spark)

    def names(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            out: list[int] = []
            for raw in _raw(batch, 1):
                out += [digest(raw[p : p + NAME]) for p in chosen(raw, window)[0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(out, dtype=np.uint64).view(np.int64))], names=["name"])

    twice = materialise(keyed.mapInArrow(names, "name long").groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name"), "twice")
    by_name = spark.sparkContext.broadcast(bitmap(twice, "name"))

    def contexts(batches):
        for batch in slices(batches):
            columns: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for k, raw in zip(batch.column(0).to_pylist(), _raw(batch, 1), strict=True):
                name, whole, first, length = named(raw, window)
                for n in np.flatnonzero(in_bitmap(by_name.value, np.asarray(name, dtype=np.int64))).tolist() if name else ():
                    for column, x in zip(columns, (k, name[n], whole[n], first[n], length[n]), strict=True):
                        column.append(x)
            kinds = (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names=["k", "name", "context", "start", "length"])

    c = keyed.mapInArrow(contexts, "k binary, name long, context binary, start int, length int")
    c = materialise(c if by_name.value is not None else c.join(twice, "name", "left_semi"), "contexts")
    g = materialise(c.groupBy("name", "context").agg(F.count("*").alias("n"), F.min(F.struct("k", "start")).alias("one")), "classes")
    whole = c.join(g.where("n > 1").select("name", "context"), ["name", "context"]).select("k", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))
    mixed_names = materialise(g.groupBy("name").agg(F.count("*").alias("classes"), F.count_if(F.col("n") == 1).alias("single")).where("classes > 1 and single > 0").select("name", "classes"), "names")

    def mixing(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mixed(shorts(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)))], names=["at"])

    asked = materialise(g.join(mixed_names, "name").select("one.k", "one.start", (F.col("classes") > group).alias("crowded")).dropDuplicates(["k", "start"]), "asked")
    by_place = spark.sparkContext.broadcast(bitmap(asked.mapInArrow(mixing, "at long"), "at"))

    def texts(batches):
        digest = xxhash.xxh3_64_intdigest
        for seen, batch in ((seen, part) for batch in batches for seen in [set()] for part in slices([batch])):
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for k, raw in zip(batch.column(0).to_pylist(), _raw(batch, 1), strict=True):
                if k in seen:  # a repeated row
                    continue
                seen.add(k)
                place, first, last = chosen(raw, window)
                at = np.flatnonzero(in_bitmap(by_place.value, mixed(np.full(len(first), short(k), dtype=np.int64), first))) if len(first) else []
                for p, a, b in zip(place[at].tolist(), first[at].tolist(), last[at].tolist(), strict=True) if len(at) else ():
                    for column, x in zip(out, (_signed(digest(raw[p : p + NAME])), k, a, p - a, raw[a : b + window]), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["name", "k", "start", "place", "bytes"])

    def compare(batches):
        """Sort the suffixes of each pool; runs of neighbouring windows become one span."""
        for pool in pools(slices(batches, 1024)):
            out: tuple[list, list, list] = ([], [], [])
            for (k, start, _), hit in zip(pool, repeated([x[2] for x in pool], window), strict=True):
                if len(hit):
                    cut = np.flatnonzero(np.diff(hit) != 1) + 1
                    a, b = hit[np.concatenate([[0], cut])], hit[np.concatenate([cut, [len(hit)]]) - 1]
                    for column, x in zip(out, ([k] * len(a), (a + start).tolist(), (b - a + window).tolist()), strict=True):
                        column.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), *(pa.array(x, pa.int64()) for x in out[1:])], names=["k", "start", "length"])

    # The bitmap lets further copies through, and repeated rows share k: one row a context goes on.
    found = keyed.mapInArrow(texts, "name long, k binary, start int, place int, bytes binary")
    asked_texts = materialise(found.join(asked, ["k", "start"]).dropDuplicates(["k", "start"]), "texts")
    dealt = asked_texts.where("not crowded").select("name", "k", "start", "bytes").repartition("name").sortWithinPartitions("name")
    spans = whole.union(dealt.mapInArrow(compare, "k binary, start long, length long"))
    for more in crowded_spans(asked_texts.where("crowded"), window):
        spans = spans.union(more)
    out = materialise(spans.groupBy("k").agg(F.collect_set(F.shiftleft(F.col("start"), 32).bitwiseOR(F.col("length"))).alias("spans")), "spans")
    while mark(spark) > before + 1:
        release_one(spark, before)
    return out


def merged(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of spans given as start << 32 | length; runs that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x >> 32, (x >> 32) + (x & 0xFFFFFFFF)) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def within_characters(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs without the bytes of characters that they would cut."""
    out = []
    for a, b in runs:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def cut_repeats(docs: DataFrame, window: int = 200, whole_characters: bool = False, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """The rows with three more columns: n_bytes, runs (array of structs start, end: the removed bytes) and kept (binary).

    Texts are UTF-8 bytes; a null text counts as empty; texts shorter than ``window`` keep all.  Repeated rows are repeats
    of each other, also if their ids are null.  With ``whole_characters`` no character is cut: its bytes stay.
    An empty table gives no rows; other columns pass through unless they have the name of a new one.
    """
    docs = docs.drop("n_bytes", "runs", "kept", "_k", "_spans")
    own_id = F.when(F.col(id_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.length(F.col(id_col).cast("string")), F.lit(":"), F.col(id_col).cast("string")))
    key = F.unhex(F.md5(F.concat(own_id, F.coalesce(F.col(text_col).cast("string"), F.lit("")))))
    spans = spans_of(docs.select(key.alias("k"), F.col(text_col).cast("string").alias("text")), window, group)
    by_key = docs.sparkSession.sparkContext.broadcast(bitmap(spans.select("k").mapInArrow(halves, "at long"), "at"))
    keyed = docs.withColumn("_k", key)
    place = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def dealt(batches, repeats: bool):
        """The rows that may have spans, or those that have none: only the first are shuffled."""
        for batch in slices(batches):
            yield batch.filter(pa.array(in_bitmap(by_key.value, shorts(batch.column(batch.num_columns - 1))) == repeats))

    def alone(batches):
        for batch in dealt(batches, False):
            yield from cut([pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.nulls(len(batch), pa.list_(pa.int64()))], names=batch.schema.names)])

    def cut(batches):
        for batch in slices(batches):
            sizes, runs, kept = [], [], []
            for raw, spans in zip(_raw(batch, place), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                own = merged(spans)
                if whole_characters:
                    own = within_characters(raw, own)
                edges = [0, *(x for r in own for x in r), len(raw)]
                sizes.append(len(raw))
                runs.append([{"start": a, "end": b} for a, b in own])
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            columns = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(runs, kind), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "n_bytes", "runs", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    met = keyed.mapInArrow(lambda batches: dealt(batches, True), f"{fields}, _k binary").join(spans.select(F.col("k").alias("_k"), F.col("spans").alias("_spans")), "_k", "left").drop("_k")
    out = f"{fields}, n_bytes long, runs array<struct<start:long,end:long>>, kept binary"
    return met.mapInArrow(cut, out).union(keyed.mapInArrow(alone, out))
