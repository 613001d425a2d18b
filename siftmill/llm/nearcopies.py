"""Groups of documents whose sets of word shingles are alike, by an exact similarity join.

The shingles of all sets are put into one order: those that are common in the corpus last.  Of two sets with a Jaccard
similarity of s or more, each has among its first n - ceil(s * n) + 1 shingles one that the other has among its first ones too
(prefix filter), and where the first common shingle stands bounds what the sets can share at all (position filter).  So
candidates meet by rare shingles; boilerplate that many documents have stands behind them and makes no candidates, unless it is
most of a document.  No link is lost, whatever the order: it decides the cost alone.  Every link is verified by the exact similarity.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmill.tables import mark, release_one

from .common import components, materialise, slices
from .simhash import SEED

#: Pairs of one center that meet one copy of its set.
SHARE = 1000
#: Shingles that count as common, the most frequent ones: their list goes to every task and has at most this length.
COMMON = 1 << 18
#: Occurrences among the sets that are counted together from which a shingle is told of, and in all from which it can be common.
SEEN, OFTEN = 3, 16
#: Shingles that are counted together, and classes that a task remembers so as not to tell of a copy again.
TOGETHER, REMEMBERED = 1 << 18, 1 << 16


def shingles(text: str | None, width: int) -> np.ndarray:
    """The different XXH64 hashes of the shingles of ``width`` words, ascending.  Fewer words than that are one shingle; no words have none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.asarray([digest(b" ".join(words), SEED)], dtype=np.uint64)
    return np.unique(np.fromiter([digest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(width)), strict=False)], dtype=np.uint64, count=len(words) - width + 1))


def prefix(hashes: np.ndarray, common: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set in the common order: rare ones by hash, then the common ones (ascending hashes with their ranks) by rank."""
    n = len(hashes)
    at = np.minimum(np.searchsorted(common, hashes), max(0, len(common) - 1))
    order = np.full(n, -1, np.int64)
    if len(common):
        known = common[at] == hashes
        order[known] = rank[at[known]]
    return hashes[np.lexsort((hashes, order))[: n - math.ceil(similarity * n - 1e-9) + 1]] if n else hashes


def short(cls: list[bytes]) -> np.ndarray:
    """64 bits of the classes' hashes.  Classes that agree in these only share buckets."""
    return np.frombuffer(b"".join(c[:8] for c in cls), dtype="<i8") if cls else np.zeros(0, np.int64)


def _met(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) with a column of the sets of both (x, y) and their sizes (m, n); an ``a`` with many pairs is spread over tasks."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    left = sets.join(shares, F.col("c") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.col(column).alias("x"), F.col("n").alias("m"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    return dealt.join(sets.select(F.col("c").alias("b"), F.col(column).alias("y"), "n"), "b").join(left, ["a", "share"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of which the sets (c, n, first, hashes) are at least so alike.

    Their prefixes (``first``, a fifth of the sets) meet before the sets do: what both sets have of the order up to the end of the shorter-reaching
    prefix is in both prefixes, so they share no more than the prefixes do and what the other set has beyond."""
    met = _met(pairs, sets, "first")
    rest = F.greatest(F.col("m") - F.size("x"), F.col("n") - F.size("y"))
    needed = (F.col("m") + F.col("n")) * (similarity / (1 + similarity)) - 1e-6
    likely = materialise(met.where(F.size(F.array_intersect("x", "y")) + rest >= needed).select("a", "b"), "likely")
    both = F.size(F.array_intersect("x", "y"))
    return _met(likely, sets, "hashes").where(both / (F.size("x") + F.size("y") - both) >= similarity).select("a", "b")


def near_copies(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", row_col: str = "_row") -> DataFrame:
    """One row per document: id, ``row_col`` (which tells different rows apart) and part, the group that links reach.

    Equal sets (by 128-bit hashes) are one class, so exact copies are never expanded into pairs.  All texts without a word are
    one class.  Within the classes that share a shingle of their prefixes links are looked for until every two that no links
    connect, and that the position filter lets through, have been compared."""

    def sketch(batches):
        """Of each document the hash of its set; of shingles that many sets have, how many."""
        held: list[np.ndarray] = []
        size = 0

        def counts():
            tokens, many = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keep = many >= SEEN
            return pa.array(tokens[keep].view(np.int64)), pa.array(many[keep].astype(np.int64))

        for batch in slices(batches):
            found = [shingles(x, width) for x in batch.column(0).to_pylist()]
            cls = [xxhash.xxh3_128_digest(h.tobytes()) for h in found]
            nulls = [pa.nulls(len(batch), pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(cls, pa.binary()), pa.array(short(cls)), *nulls], names=names)
            for h in found:
                held.append(h)
                size += len(h)
                if size >= TOGETHER:
                    yield told(*counts())
                    held, size = [], 0
        yield told(*counts())

    def told(tokens, many):
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(tokens), t) for t in kinds), tokens, many], names=names)

    source = docs.select(F.col(text_col).cast("string").alias("_text"), id_col, row_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    names = [id_col, row_col, "cls", "s", "token", "many"]
    kinds = [*(pa.schema([(f.name, _arrow(f.dataType.simpleString()))]).field(0).type for f in source.schema.fields[1:]), pa.binary(), pa.int64()]
    sketches = materialise(source.mapInArrow(sketch, f"{fields}, cls binary, s long, token long, many long"), "sketches")
    rows = sketches.where("token is null").select(id_col, row_col, "cls", "s")
    often = sketches.where("token is not null").groupBy("token").agg(F.sum("many").alias("many")).where(F.col("many") >= OFTEN)
    top = often.orderBy(F.desc("many"), "token").limit(COMMON).toArrow()
    common = top.column("token").to_numpy().view(np.uint64)
    rank = np.arange(len(common), 0, -1)
    common, rank = common[np.argsort(common)], rank[np.argsort(common)]
    shared = source.sparkSession.sparkContext.broadcast((common, rank))

    def firsts(batches):
        """The prefix of each set as one row a shingle; of equal sets in one task, as far as they are remembered, once."""
        seen: set[bytes] = set()
        for batch in slices(batches):
            found, cls = [], []
            for x in batch.column(0).to_pylist():
                h = shingles(x, width)
                own = xxhash.xxh3_128_digest(h.tobytes())
                if own not in seen:
                    seen.add(own)
                    found.append((prefix(h, *shared.value, similarity), len(h)))
                    cls.append(own)
            if len(seen) > REMEMBERED:
                seen.clear()
            if found:
                many = np.array([len(f) for f, _ in found])
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                # the largest other set with which a set can be alike if this is the first shingle that both have
                n = np.repeat(np.array([n for _, n in found]), many)
                most = np.floor((n - at) * ((1 + similarity) / similarity) - n + 1e-6).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f for f, _ in found]).view(np.int64)), pa.array(np.repeat(short(cls), many)), pa.array(n << 32 | np.maximum(most, 0))], names=["token", "s", "size"])

    def hashes(batches):
        for batch in slices(batches):
            found = [shingles(x, width) for x in batch.column(0).to_pylist()]
            first = [prefix(h, *shared.value, similarity).view(np.int64) for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([len(h) for h in found], pa.int32()), pa.array(first, pa.list_(pa.int64())), pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))], names=["c", "n", "first", "hashes"])

    before = mark(source.sparkSession)
    tokens = materialise(source.select("_text").mapInArrow(firsts, "token long, s long, size long"), "tokens")
    n, most = F.shiftright("size", 32), F.col("size").bitwiseAND((1 << 32) - 1)
    # a token needs a set that can be the smaller of a pair, and another one
    open_ = tokens.groupBy("token").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.bool_or(most >= n).alias("smaller")).where("low != high and smaller").select("token")
    near = materialise(tokens.join(open_, "token", "left_semi").distinct(), "near")
    release_one(source.sparkSession, before)  # the tokens of all sets are the largest table, and no longer read
    classes = materialise(rows.groupBy("cls").agg(F.min(row_col).alias("one"), F.min("s").alias("s")).withColumn("c", F.monotonically_increasing_id()), "classes")
    keyed = materialise(near.join(classes.select("s", "c"), "s").select("token", "c", n.cast("int").alias("n"), most.cast("int").alias("most")), "buckets")
    wanted = classes.join(keyed.select("c").distinct(), "c", "left_semi").select("c", "one")
    sets = source.join(wanted, F.col(row_col) == F.col("one")).dropDuplicates([row_col]).select("_text", "c")  # by the join's own key: no further shuffle
    sets = materialise(sets.mapInArrow(hashes, "c long, n int, first array<long>, hashes array<long>"), "sets")

    def alone(step: int):
        """How much of a set stands before its first shared shingle, in hundredths; an original of which there are many copies has next to nothing of its own, so it is the center that they link to.  The last center is any."""
        return F.when(F.lit(step < 2), F.floor(100 - 100 * F.col("most") / F.col("n"))).otherwise(0).cast("int")

    edges, parts = None, None
    for step in (0, 1, 2, None):
        own = keyed.withColumn("label", F.col("c"))
        if parts is not None:
            own = keyed.join(parts.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("component", "c")).drop("component")
        unlike = own.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("token")
        own = materialise(own.join(unlike, "token", "left_semi"), "open")
        if own.isEmpty():
            break
        if step is None:  # all that can be the smaller of a pair and are not in the bucket's largest part meet the others; so do the larger of pairs
            top = own.groupBy("token", "label").count().groupBy("token").agg(F.max(F.struct("count", "label")).alias("top")).select("token", "top.label")
            center = own.join(top, ["token", "label"], "left_anti")
        else:  # all meet one of the bucket
            center = own.groupBy("token").agg(F.min(F.struct(alone(step), F.xxhash64("c", F.lit(step)), "c", "n", "most", "label")).alias("one")).select("token", "one.c", "one.n", "one.most", "one.label")
        center = center.select("token", F.col("c").alias("a"), F.col("n").alias("m"), F.col("most").alias("reach"), F.col("label").alias("part"), alone(step or 0).alias("alone"))
        alike = (F.col("n") <= F.col("reach")) & (F.col("m") <= F.col("most"))
        pairs = own.join(center, "token").where(F.col("label") != F.col("part")).where(alike).select("a", F.col("c").alias("b"), "alone")
        if step is not None:  # of the centers that a set meets one, the same for most of a group
            pairs = pairs.groupBy("b").agg(F.min(F.struct("alone", F.xxhash64("a", F.lit(step)), "a")).alias("one")).select("one.a", "b")
        pairs = pairs.select("a", "b")
        pairs = materialise(pairs.distinct(), "pairs")
        found = materialise(verified(pairs, sets, similarity), "verified")
        edges = found if edges is None else edges.union(found)
        parts = materialise(components(edges), "parts")
    out = rows.join(classes.select("cls", "c"), "cls").select(id_col, row_col, "c")
    if parts is None:
        return out.select(id_col, row_col, F.col("c").alias("part"))
    return out.join(parts, F.col("c") == F.col("node"), "left").select(id_col, row_col, F.coalesce("component", "c").alias("part"))


def _arrow(kind: str) -> pa.DataType:
    """The Arrow type of a column of keys."""
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[kind]
