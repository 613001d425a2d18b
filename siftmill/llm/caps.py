"""Embedding near-duplicates with spherical-cap filters.

The coordinates are cut into blocks and each block has a codebook of random directions; every choice of one direction a
block is a filter (a random product code).  A vector is list-decoded to all filters whose direction it exceeds by the cap's
threshold, and to its best few in any case: as many as random pairs at the cosine's threshold need to meet (``measured``).  Vectors that share a filter, a label and a dimension meet and are verified in
double precision.  A linked pair counts at the smallest filter that both have.  Equal vectors are one class throughout, and
crowded filters are cut into tiles of which every two meet.
"""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

BLOCKS = 3
#: Share of random pairs at the threshold that are to share a filter, and the filters a vector that this may take.
RECALL = 0.995
MOST_FILTERS = 64
#: Crowded filters up to so many are broadcast; beyond that they are joined by a shuffle.
MOST_BROADCAST = 100_000


def codebooks(dim: int, size: int) -> list[np.ndarray]:
    """Random unit directions of each block of coordinates, the same in every task."""
    rng = np.random.default_rng([dim, size])
    out = []
    for part in np.array_split(np.arange(dim), BLOCKS):
        c = rng.standard_normal((size, len(part)))
        out.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300))
    return out


@cache
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task.  It spreads what vectors have in a few coordinates over all blocks: a pair of any
    directions then meets as often as a random pair does."""
    q, r = np.linalg.qr(np.random.default_rng([dim, 7]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _gains(units: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each block the products of unit vectors with its directions, best first, and these directions."""
    rank, gain = [], []
    for part, book in zip(np.array_split(np.arange(units.shape[1]), BLOCKS), codebooks(units.shape[1], size), strict=True):
        a = units[:, part] @ book.T if len(part) else np.zeros((len(units), size))
        order = np.argsort(-a, axis=1, kind="stable")
        rank.append(order)
        gain.append(np.take_along_axis(a, order, axis=1))
    return rank, gain


def _over(gain: list[np.ndarray], threshold: float) -> tuple[np.ndarray, ...]:
    """All choices of one place a block whose gains (each falling) sum to the threshold or more: their places and sums.

    Blocks are gone through best first and only as far as the best of the others can still lift a sum over the threshold."""
    a, b, c = gain
    i = a[: np.searchsorted(-a, b[0] + c[0] - threshold, side="right")]
    j = b[: np.searchsorted(-b, a[0] + c[0] - threshold, side="right")]
    both = i[:, None] + j[None, :]
    many = np.searchsorted(-c, both - threshold, side="right")
    x, y = np.nonzero(many)
    times = many[x, y]
    z = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    x, y = np.repeat(x, times), np.repeat(y, times)
    return x, y, z, both[x, y] + c[z]


def _best(gain: list[np.ndarray], n: int) -> tuple[np.ndarray, ...]:
    """The n choices with the largest sums, largest first: places and sums.  The choice of rank r has places of which the product of the ranks is at most r, so n is enough of each block."""
    x, y, z = _products(n, len(gain[0]))
    total = gain[0][x] + gain[1][y] + gain[2][z]
    at = np.argsort(-total, kind="stable")[:n]
    return x[at], y[at], z[at], total[at]


@cache
def _products(n: int, size: int) -> tuple[np.ndarray, ...]:
    """Places below ``size`` of three blocks of which the ranks, from 1 on, have a product of at most n."""
    rank = np.arange(1, min(n, size) + 1)
    return np.nonzero(rank[:, None, None] * rank[None, :, None] * rank[None, None, :] <= n)


def _filters(rank: list[np.ndarray], places: tuple[np.ndarray, ...], size: int) -> np.ndarray:
    x, y, z = (r[p] for r, p in zip(rank, places, strict=True))
    return (x * size + y) * size + z


def decode(units: np.ndarray, size: int, expected: float, least: int) -> list[np.ndarray]:
    """Filters of each unit vector, ascending: all over the threshold that a random vector exceeds ``expected`` times on average, and the ``least`` best."""
    threshold = NormalDist().inv_cdf(max(0.5, 1 - expected / size**BLOCKS)) / math.sqrt(units.shape[1]) * math.sqrt(BLOCKS)
    rank, gain = _gains(units, size)
    out = []
    for k in range(len(units)):
        own, order = [g[k] for g in gain], [r[k] for r in rank]
        *places, sums = _over(own, threshold)
        if len(sums) < least:
            *places, sums = _best(own, least)
        out.append(np.sort(_filters(order, tuple(places), size)))
    return out


def turned(x: np.ndarray) -> np.ndarray:
    """Unit vectors of the rows, rotated."""
    return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ rotation(x.shape[1])


def random_pairs(dim: int, cosine: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at a cosine, in random directions."""
    rng = np.random.default_rng([dim, n, seed])
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-300)


def measured(dim: int, size: int, cosine: float) -> tuple[int, int]:
    """Size of the codebooks and number of best filters a vector, so that of 1,000 random pairs at the cosine RECALL share a filter.

    The size is halved where over MOST_FILTERS filters were needed: in few dimensions large codebooks tell too little apart."""
    pairs = random_pairs(dim, cosine, 1000, 1) if dim >= BLOCKS else None  # a block without coordinates tells nothing apart
    while size > 1 and pairs is not None:
        best = []
        for x in pairs:
            rank, gain = _gains(x, size)
            best.append([_filters([r[k] for r in rank], _best([g[k] for g in gain], MOST_FILTERS)[:3], size) for k in range(len(x))])
        needed = []
        for a, b in zip(*best, strict=True):
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            needed.append(np.maximum(i, j).min() + 1 if len(i) else MOST_FILTERS + 1)
        least = int(np.sort(needed)[math.ceil(RECALL * len(needed)) - 1])
        if least <= MOST_FILTERS:
            return size, least
        size //= 2
    return 1, 1


def _meet(ids: np.ndarray, own: np.ndarray, weight: np.ndarray, x: np.ndarray, filters: list[np.ndarray], at: int, cross: bool, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of one meeting: the weight that each row gains, and links that connect what is linked."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components would leave the range of doubles
    norm = np.sqrt((x * x).sum(axis=1))
    linked = (x @ x.T) / np.outer(norm, norm) >= threshold
    np.fill_diagonal(linked, False)
    if cross:
        linked &= own[:, None] != own[None, :]
    rows = np.flatnonzero(linked.any(axis=1))
    gained = np.zeros(len(ids), dtype=np.int64)
    if not len(rows):
        return gained, []
    linked = linked[np.ix_(rows, rows)]
    smaller = [f[f < at] for f in (filters[r] for r in rows)]
    known, where, times = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
    shared = times[where] > 1
    if shared.any():  # pairs that already met at a smaller filter
        own_row = np.repeat(np.arange(len(rows)), [len(f) for f in smaller])[shared]
        has = np.zeros((len(rows), len(known)), dtype=np.float32)
        has[own_row, where[shared]] = 1
        has = has[:, times > 1]
        linked &= has @ has.T < 0.5
    gained[rows] = linked @ weight[rows]
    label = ids[rows].copy()
    while True:
        low = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        new = np.minimum(label, low)
        if (new == label).all():
            break
        label = new
    return gained, [(int(a), int(b)) for a, b in zip(ids[rows], label, strict=True) if a != b]


def link_vectors(vectors: DataFrame, threshold: float = 0.98, expected: float = 16.0, least: int = 8, tile: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null and the cosine of found pairs is at least ``threshold``.  Vectors
    that are null, empty, zero or hold null or non-finite components, and rows whose id is null, link with nothing:
    n_links 0, component_id their id, kept true (null ids: false).  Vectors of different lengths do not link.  Repeated
    rows link with each other.  Other columns are ignored; an empty table gives no rows.
    """
    vectors = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(vector_col) if dict(vectors.dtypes)[vector_col] == "array<float>" else F.col(vector_col).cast("array<double>")).alias("v"), F.col(label_col).alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = materialise(vectors.withColumn("v", F.when(usable, F.col("v"))), "vectors")
    classes = materialise(rows.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("weight")), "classes")
    n = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    size = min(256, max(7, math.ceil((n / 16) ** (1 / BLOCKS))))  # a filter then has about 16 times ``expected`` vectors of a label
    settings = {r["dim"]: measured(r["dim"], size, threshold) for r in classes.select(F.size("v").alias("dim")).distinct().collect()}

    def filters(batches):
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, len(batch), 512)):
                values = part.column(1).to_pylist()
                found: list = [None] * len(values)
                for dim in {len(v) for v in values}:
                    at = [k for k, v in enumerate(values) if len(v) == dim]
                    x = np.array([values[k] for k in at], dtype=np.float64)
                    x /= np.abs(x).max(axis=1, keepdims=True)
                    for k, f in zip(at, decode(turned(x), settings[dim][0], expected, max(least, settings[dim][1])), strict=True):
                        found[k] = f
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), part.column(3), pa.array(found, pa.list_(pa.int32()))], names=["id", "v", "label", "weight", "filters"])

    kind = dict(classes.dtypes)["label"]
    decoded = materialise(classes.select("id", "v", "label", "weight").mapInArrow(filters, f"id long, v {dict(classes.dtypes)['v']}, label {kind}, weight long, filters array<int>"), "filters")
    bucket = F.xxhash64("label", F.size("v"), "filter")
    keys = decoded.select("label", "v", F.explode("filters").alias("filter")).select(bucket.alias("bucket"))
    crowd = materialise(keys.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > tile).select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "crowd")
    n_crowd = crowd.count()
    dealt = decoded.withColumn("filter", F.explode("filters")).withColumn("bucket", bucket)
    if n_crowd:
        dealt = dealt.join(F.broadcast(crowd) if n_crowd <= MOST_BROADCAST else crowd, "bucket", "left")
    tiles = F.coalesce("tiles", F.lit(1)) if n_crowd else F.lit(1)
    dealt = dealt.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"), (F.col("own") != F.col("other")).alias("cross"), "own", "filter", "id", "weight", "v", "filters")
    # a tile's meetings with other tiles hold its rows and theirs; only pairs across count there
    dealt = dealt.repartition("meeting").sortWithinPartitions("meeting", "id")

    def meet(batches):
        last, rows = None, []

        def close(out):
            if len(rows) > 1:
                ids = np.array([r[4] for r in rows], dtype=np.int64)
                weight = np.array([r[5] for r in rows], dtype=np.int64)
                gained, pairs = _meet(ids, np.array([r[2] for r in rows]), weight, np.array([r[6] for r in rows], dtype=np.float64), [np.array(r[7], dtype=np.int64) for r in rows], rows[0][3], rows[0][1], threshold)
                at = np.flatnonzero(gained)
                out += [(int(i), int(g), None) for i, g in zip(ids[at], gained[at], strict=True)] + [(a, 0, b) for a, b in pairs]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["id", "links", "other"])

        for batch in batches:
            out: list = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    close(out)
                    last, rows = row[0], []
                rows.append(row)
            yield batch_of(out)
        out = []
        close(out)
        yield batch_of(out)

    found = materialise(dealt.mapInArrow(meet, "id long, links long, other long"), "links")
    counts = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    told = classes.join(counts, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    told = materialise(told.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component")), "told")
    n_links, part = F.coalesce("links", F.lit(0).cast("long")), F.coalesce("component", "id")
    return rows.join(told, ["label", "v"], "left").select(F.col("id").alias(id_col), n_links.alias("n_links"), part.alias("component_id"), F.coalesce(part == F.col("id"), F.lit(False)).alias("kept"))
