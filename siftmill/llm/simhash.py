"""SimHash near-duplicate detection with sharded BK-trees.

Fingerprints of word shingles are reduced to distinct values.  Each is sent to the shards that any partner within the
radius shares with it: 64 bits are cut into blocks, and two values that differ in at most ``radius`` bits agree in at
least ``blocks - radius`` of them, so a shard is a choice of that many blocks with their bits.  In every shard a BK-tree
is built and searched, and only the links that join its members into groups leave it.  Hot shards are cut into tiles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise, slices

SEED = 42


def fingerprint(text: str | None, width: int) -> int:
    """64 bits: each is 1 if it is set in over half of the XXH64 hashes of the shingles of ``width`` words, repeats included.  Fewer words than that are one shingle; no words give 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(b" ".join(x), SEED) for x in zip(*(words[k:] for k in range(width)), strict=False)], dtype=np.uint64, count=n - width + 1)
    m = len(hashes)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, m, 65536):
        part = np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > m, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of ``keep``, and fp (the 64 bits as a signed long) of every row."""

    def run(batches):
        for batch in slices(batches):
            fp = np.asarray([fingerprint(x, width) for x in batch.column(0).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(fp.view(np.int64))], names=[*batch.schema.names[1:], "fp"])

    source = docs.select(F.col(text_col).cast("string").alias("_text"), id_col, *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:])
    return source.mapInArrow(run, f"{fields}, fp long")


class BKTree:
    """Fingerprints by integer Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def search(self, value: int, radius: int) -> list[int]:
        """Places of all values within the radius: only edges whose key lies within the radius of the distance are followed."""
        if not self.values:
            return []
        found, todo, values, children = [], [0], self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if below:
                if len(below) <= 2 * radius:
                    todo.extend(x for k, x in below.items() if -radius <= k - d <= radius)
                else:
                    todo.extend(below[k] for k in range(d - radius, d + radius + 1) if k in below)
        return found

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while at != new:
            d = (self.values[at] ^ value).bit_count()
            at = self.children[at].setdefault(d, new)


def shard_keys(fp, blocks: int, radius: int):
    """Array of the shards of a fingerprint column."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.xxhash64(F.lit(n), *(part[k] for k in chosen)) for n, chosen in enumerate(combinations(range(blocks), blocks - radius))])


def _join_shard(fps: list[int], ids: list[int], radius: int) -> tuple[list[int], list[int]]:
    """Links (id, smallest id of its group) of one shard, found by its BK-tree."""
    tree, parent = BKTree(), list(range(len(fps)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for n, value in enumerate(fps):
        for k in tree.search(value, radius):
            a, b = root(k), root(n)
            if a != b:
                a, b = (a, b) if ids[a] < ids[b] else (b, a)
                parent[b] = a
        tree.add(value)
    linked = [k for k in range(len(fps)) if root(k) != k]
    return [ids[k] for k in linked], [ids[root(k)] for k in linked]


def links(classes: DataFrame, radius: int = 3, blocks: int = 5, tile: int = 2000) -> DataFrame:
    """Links (a, b) between the ids of distinct fingerprints (fp, id) that connect all that are within the radius.

    A shard of more than ``tile`` values is cut into tiles, and every two tiles meet: no shard, however hot, is one task.
    """
    keyed = classes.select("fp", "id", F.explode(shard_keys(F.col("fp"), blocks, radius)).alias("shard"))
    shared = keyed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    dealt = keyed.join(shared, "shard").select("fp", "id", "shard", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    dealt = dealt.select("fp", "id", F.xxhash64("shard", F.least("own", "other"), F.greatest("own", "other")).alias("meeting")).repartition("meeting").sortWithinPartitions("meeting", "id")

    def run(batches):
        last, fps, ids = None, [], []
        out: tuple[list[int], list[int]] = ([], [])

        def close():
            if len(fps) > 1:
                for column, more in zip(out, _join_shard([x & 0xFFFFFFFFFFFFFFFF for x in fps], ids, radius), strict=True):
                    column.extend(more)

        for batch in batches:
            for fp, own_id, meeting in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if meeting != last:
                    close()
                    last, fps, ids = meeting, [], []
                fps.append(fp)
                ids.append(own_id)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])
            out[0].clear()
            out[1].clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the columns of ``keep``, fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    A null or empty text has fingerprint 0, linked like any other.  Equal fingerprints are one class, so groups of copies
    are never expanded into pairs; repeated rows are alike.  A row whose id is null belongs to the component of the rows
    with its fingerprint and links nothing by itself (null if there is no such row).  Other columns are ignored.
    """
    fps = materialise(fingerprints(docs, width, id_col, text_col, keep), "fps")
    classes = materialise(fps.groupBy("fp").agg(F.min(id_col).cast("long").alias("id")).where("id is not null"), "classes")
    parts = components(links(classes, radius))
    to = materialise(classes.join(parts, F.col("id") == F.col("node"), "left").select("fp", F.coalesce("component", "id").alias("component_id")), "members")
    return fps.join(to, "fp", "left").select(id_col, *keep, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_groups(docs: DataFrame, width: int = 3, radius: int = 3, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns of ``keep`` and part, the smallest fingerprint (as a signed long) that links reach.

    The links are those of ``near_duplicates``, but groups are told by fingerprints instead of ids, so rows without an id link like any other."""
    fps = materialise(fingerprints(docs, width, keep[0], text_col, keep[1:]), "fps")
    classes = materialise(fps.select("fp", F.col("fp").alias("id")).distinct(), "classes")
    parts = materialise(components(links(classes, radius)), "parts")
    return fps.join(parts, F.col("fp") == F.col("node"), "left").select(*keep, F.coalesce("component", "fp").alias("part"))
