"""Hard negatives by lists that clusters of anchors share.

Anchors are clustered by direction.  For a cluster with center c and widest angle b between c and a member, no member's
score with a row can exceed norm(member) * norm(row) * cos(max(0, angle(row, c) - b)).  Each cluster's rows are sorted by that bound
once, and every member walks the one list until the bound says that nothing further can change its result.

The list of a cluster is cut into tiers by the bound.  A tier is walked by many tasks, which hold bounded blocks of rows and of
members; after each tier only members that are not certified go on, and rows of a tier are sent only to clusters that have
such members.  First each anchor's positives are found so, then the negatives in the window of scores below each positive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

CLUSTERS = 8
#: Anchors that the centers are fitted on, and rows that the tiers' bounds are chosen on; both touch speed only.
SAMPLE = 4096
#: Shares of a cluster's list at which its tiers end; a last tier has the rest.
TIERS = (1 / 16, 1 / 3)
#: Rows and members that meet in one task at a time, and rows that are scored before the bound is looked at again.
ROWS, MEMBERS, STEP = 4096, 512, 512
#: Components saturate here after scaling, so that scores of up to 128 components fit into 64 bits.
MOST = 1 << 28
_SLACK = 1e-9


def unpacked(vectors: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors of one length as rows of doubles."""
    return np.frombuffer(b"".join(vectors), dtype="<i4").reshape(len(vectors), dim).astype(np.float64)


def centers(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Unit centers of a spherical k-means over the rows of x that are not zero."""
    norm = np.linalg.norm(x, axis=1)
    x = x[norm > 0] / norm[norm > 0, None]
    if not len(x):
        return np.zeros((1, x.shape[1] if x.ndim == 2 else 0))
    c = x[np.random.default_rng(3).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
    return c


def angles(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of rows and their angles to each center; a zero row or center has angle 0, which bounds nothing away."""
    norm, size = np.linalg.norm(x, axis=1), np.linalg.norm(c, axis=1)
    out = np.arccos(np.clip((x @ c.T) / np.maximum(norm, 1e-300)[:, None], -1, 1))
    out[norm == 0], out[:, size == 0] = 0, 0
    return norm, out


def bounds(norm: np.ndarray, angle: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """Most that a member of norm one can score with each row, by cluster."""
    most = norm[:, None] * np.cos(np.maximum(0, angle - widest - 1e-7))
    return most + np.abs(most) * _SLACK


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    most = max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) * a.shape[1]
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def walk(asks: list[dict], ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, x: np.ndarray, bound: np.ndarray) -> list[tuple]:
    """What each ask finds among the rows: its best ``most`` of (score falling, id rising, row) between low and high, of its anchor's label or of others.

    The list is gone along by falling bound.  An ask leaves it once the bound is below all that it still takes."""
    order = np.argsort(-bound, kind="stable")
    q = unpacked([a["v"] for a in asks], x.shape[1])
    norm = np.linalg.norm(q, axis=1)
    label, anchor, same = (np.array([a[k] for a in asks]) for k in ("label", "anchor", "same"))
    low, high = np.array([a["low"] for a in asks], np.int64), np.array([a["high"] for a in asks], np.int64)
    found: list[list[tuple]] = [[] for _ in asks]
    for at in range(0, len(order), STEP):
        part = order[at : at + STEP]
        reach = bound[part[0]] * norm
        act = np.flatnonzero(reach + np.abs(reach) * _SLACK >= low)
        if not len(act):
            break
        s = scores(q[act], x[part])
        ok = ((label[act][:, None] == labels[part]) == same[act][:, None]) & (anchor[act][:, None] != rows[part]) & (s >= low[act][:, None]) & (s <= high[act][:, None])
        for k in np.flatnonzero(ok.any(axis=1)).tolist():
            a, most = act[k], asks[act[k]]["most"]
            hit = np.flatnonzero(ok[k])
            best = hit[np.lexsort((rows[part[hit]], ids[part[hit]], -s[k, hit]))[:most]]
            found[a] = sorted(found[a] + [(-int(s[k, j]), int(ids[part[j]]), int(rows[part[j]])) for j in best])[:most]
            if len(found[a]) == most:
                low[a] = max(low[a], -found[a][-1][0])  # rows of equal score may still have smaller ids
    return [(int(anchor[k]), asks[k]["slot"], -s, i, r) for k, own in enumerate(found) for s, i, r in own]


ASK = "anchor long, slot int, cluster int, dim int, same boolean, low long, high long, most int"
FOUND = "anchor long, slot int, score long, id long, row long"
NO_ID = np.iinfo(np.int64).max


class Lists:
    """The clusters of a set of anchors and the lists of rows that they share.  ``rows``: row, id, label, dim and v (packed)."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        self.rows, self.anchors = rows, anchors

        def sample(df: DataFrame) -> dict[int, np.ndarray]:
            seen: dict[int, list] = {}
            for r in df.select("dim", "v", F.xxhash64("row").alias("h")).orderBy("h").limit(SAMPLE).collect():
                seen.setdefault(r["dim"], []).append(bytes(r["v"]))
            return {d: unpacked(v, d) for d, v in seen.items()}

        self.centers = fitted = {d: centers(x, CLUSTERS) for d, x in sample(anchors).items()}

        def place(batches):
            for batch in batches:
                v, dims = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                own, angle, norm = np.zeros(len(v), np.int32), np.zeros(len(v)), np.zeros(len(v))
                for d in np.unique(dims).tolist():
                    k = np.flatnonzero(dims == d)
                    norm[k], a = angles(unpacked([v[j] for j in k], d), fitted.get(d, np.zeros((1, d))))
                    own[k], angle[k] = a.argmin(axis=1), a.min(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own), batch.column(2), pa.array(angle), pa.array(norm)], names=["anchor", "cluster", "dim", "angle", "norm"])

        self.members = materialise(anchors.select("row", "v", "dim").mapInArrow(place, "anchor long, cluster int, dim int, angle double, norm double"), "members")
        self.widest: dict[int, np.ndarray] = {}
        for r in self.members.groupBy("dim", "cluster").agg(F.max("angle").alias("widest")).collect():
            c = self.widest.setdefault(r["dim"], np.zeros(len(fitted.get(r["dim"], [0]))))
            c[r["cluster"]] = r["widest"]
        self.sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect() if r["dim"] in self.widest}
        known = sample(rows)
        self.ends: dict[int, np.ndarray] = {}  # by dim: for each tier but the last, each cluster's bound at its end
        for d, widest in self.widest.items():
            if d in known:
                own = -np.sort(-self._bounds(d, known[d]), axis=0)
                self.ends[d] = np.stack([own[min(len(own) - 1, int(t * len(own)))] for t in TIERS])
            else:
                self.ends[d] = np.full((len(TIERS), len(widest)), -np.inf)

    def _bounds(self, dim: int, x: np.ndarray) -> np.ndarray:
        norm, angle = angles(x, self.centers.get(dim, np.zeros((1, dim))))
        return bounds(norm, angle, self.widest[dim])

    def tier(self, asks: DataFrame, tier: int) -> DataFrame:
        """What the asks (ASK) find in one tier of their clusters' lists."""
        shares = np.diff([0, *TIERS, 1])
        chunks = {d: int(np.ceil(n * shares[tier] / ROWS)) for d, n in self.sizes.items()}
        groups = {(r["dim"], r["cluster"]): int(np.ceil(r["count"] / MEMBERS)) for r in asks.groupBy("dim", "cluster").count().collect()}
        wanted: dict[int, list[tuple[int, int]]] = {}
        for (d, c), many in groups.items():
            wanted.setdefault(d, []).append((c, many))
        ends, told = self.ends, {d: sorted(v) for d, v in wanted.items()}
        fitted, widest = self.centers, self.widest

        def deal(batches):
            for batch in batches:
                for part in (batch.slice(i, 2048) for i in range(0, len(batch), 2048)):
                    v, row, dims = part.column(3).to_pylist(), part.column(0).to_numpy(), part.column(4).to_numpy()
                    at, cell, bound = [], [], []
                    for d in set(dims.tolist()) & set(told):
                        k = np.flatnonzero(dims == d)
                        norm, angle = angles(unpacked([v[j] for j in k], d), fitted.get(d, np.zeros((1, d))))
                        b = bounds(norm, angle, widest[d])
                        which = (b[:, None, :] < ends[d][None]).sum(axis=1)
                        chunk = (row[k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % chunks[d]
                        for c, many in told[d]:
                            j = np.flatnonzero(which[:, c] == tier)
                            for g in range(many):
                                at.append(k[j])
                                bound.append(b[j, c])
                                cell.append(np.stack([np.full(len(j), d), np.full(len(j), c), np.full(len(j), g), chunk[j]], axis=1))
                    if at and sum(map(len, at)):
                        taken = part.select(["row", "id", "label", "v"]).take(pa.array(np.concatenate(at)))
                        cells = np.concatenate(cell)
                        names = ["dim", "cluster", "grp", "chunk", "bound", *taken.schema.names]
                        yield pa.RecordBatch.from_arrays([*(pa.array(cells[:, i], pa.int32()) for i in range(4)), pa.array(np.concatenate(bound)), *taken.columns], names=names)

        lists = self.rows.select("row", "id", "label", "v", "dim").mapInArrow(deal, "dim int, cluster int, grp int, chunk int, bound double, row long, id long, label long, v binary")
        sizes = self.rows.sparkSession.createDataFrame([(d, c, many, chunks[d]) for (d, c), many in groups.items()], "dim int, cluster int, many int, chunks int")
        members = asks.join(F.broadcast(sizes), ["dim", "cluster"]).withColumn("grp", F.pmod(F.xxhash64("anchor", "slot"), F.col("many")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        members = members.join(self.anchors.select(F.col("row").alias("anchor"), "label", "v"), "anchor").select("dim", "cluster", "grp", "chunk", "anchor", "slot", "same", "low", "high", "most", "label", "v")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            got: list[tuple] = []
            if len(left) and len(right):
                x = unpacked(right.column("v").to_pylist(), left.column("dim")[0].as_py())
                got = walk(left.to_pylist(), *(right.column(c).to_numpy() for c in ("id", "row", "label")), x, right.column("bound").to_numpy())
            return pa.table([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["anchor", "slot", "score", "id", "row"])

        key = ["dim", "cluster", "grp", "chunk"]
        return members.groupBy(*key).cogroup(lists.groupBy(*key)).applyInArrow(meet, FOUND)

    def all(self, asks: DataFrame, limit: int) -> DataFrame:
        """What the asks find in the whole lists: tier after tier, until every ask is certified."""
        found, tiers = None, len(TIERS) + 1
        norms = self.members.select("anchor", "norm")
        asks = materialise(asks, "asks")
        first = asks
        for tier in range(tiers):
            if asks.isEmpty():
                break
            new = self.tier(asks, tier)
            found = materialise(best(new if found is None else found.drop("rank").union(new), first, limit), "found")
            if tier + 1 < tiers:
                ends = [(d, c, float(e[tier, c])) for d, e in self.ends.items() for c in range(e.shape[1])]
                end = self.rows.sparkSession.createDataFrame(ends, "dim int, cluster int, bound double")
                so_far = found.groupBy("anchor", "slot").agg(F.count("*").alias("n"), F.min("score").alias("least"))
                open_ = asks.join(so_far, ["anchor", "slot"], "left").join(F.broadcast(end), ["dim", "cluster"]).join(norms, "anchor")
                low = F.when(F.col("n") >= F.col("most"), F.greatest("low", "least")).otherwise(F.col("low"))
                asks = materialise(open_.withColumn("low", low).withColumn("reach", F.col("bound") * F.col("norm")).where(F.col("reach") + F.abs("reach") * _SLACK >= F.col("low")).select(*first.columns), "asks")
        return found if found is not None else self.rows.sparkSession.createDataFrame([], FOUND + ", rank int")


def best(found: DataFrame, asks: DataFrame, limit: int) -> DataFrame:
    """The first ``most`` rows found of each ask, ``limit`` at most; every task drops what is beyond the limit before the shuffle."""
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.join(asks.select("anchor", "slot", F.col("most").alias("_most")), ["anchor", "slot"]).where(F.col("rank") <= F.col("_most")).select("anchor", "slot", "score", "id", "row", "rank")


def prepared(vectors: DataFrame, scale: int, relabel: tuple[int, int], id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows that take part (row, vec_id, id, label, dim, v): neither label nor vector null, all components finite.  ``v`` is packed: the whole
    numbers as little-endian 32-bit ones.  ``id`` comes after all others where vec_id is null."""
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % relabel[0] == 0, (F.col("label") + 1) % relabel[1]).otherwise(F.col("label"))

    def packed(batches):
        for batch in batches:
            lists = batch.column(3)
            whole = np.clip(np.floor(np.clip(lists.flatten().to_numpy(zero_copy_only=False) * scale, -1e15, 1e15)), -MOST, MOST).astype("<i4").tobytes()
            ends = 4 * np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            v = [whole[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists.value_lengths().cast(pa.int32()), pa.array(v, pa.binary())], names=["vec_id", "id", "label", "dim", "v"])

    rows = own.select("vec_id", F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), label.alias("label"), "v")
    rows = rows.mapInArrow(packed, "vec_id long, id long, label long, dim int, v binary")
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256, relabel: tuple[int, int] = (7, 10), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Rows with a null label, a null vector or a null or non-finite component take no part.  A component x becomes
    floor(``scale`` * x), and saturates at 2 ** 28; scores are inner products of these whole numbers.  Where vec_id is
    divisible by ``relabel[0]``, the label becomes (label + 1) % ``relabel[1]``.  Anchors are the rows whose vec_id is divisible by ``every``; their
    positives are the first other rows of their label, by falling score and rising vec_id, and their negatives for each positive the
    first rows of other labels with a score between ``low`` and ``high`` hundredths of the positive's.  Null ids come last among equal scores and are
    never anchors.  Repeated rows are rows each.  Vectors meet only vectors of their length; empty ones score 0.  Other columns are
    ignored; a table without anchors gives no rows."""
    rows = prepared(vectors, scale, relabel, id_col, vector_col, label_col)
    anchors = materialise(rows.where(F.col("vec_id") % every == 0), "anchors")
    lists = Lists(rows, anchors)
    others = rows.groupBy("label", "dim").agg((F.count("*") - 1).alias("others"))
    asks = lists.members.join(anchors.select(F.col("row").alias("anchor"), "label"), "anchor").join(others, ["label", "dim"])
    far = 1 << 62
    asks = asks.select("anchor", F.lit(0).alias("slot"), "cluster", "dim", F.lit(True).alias("same"), F.lit(-far).alias("low"), F.lit(far).alias("high"), F.least(F.lit(positives), "others").cast("int").alias("most")).where("most > 0")
    near = lists.all(asks, positives).select("anchor", F.col("rank").alias("slot"), "id", "score")
    near = materialise(near, "positives")
    part = lambda c, share: (F.col(c).cast("decimal(20,0)") * share / 100)
    asks = near.where("score >= 0").join(lists.members, "anchor").select("anchor", "slot", "cluster", "dim", F.lit(False).alias("same"), F.ceil(part("score", low)).cast("long").alias("low"), F.floor(part("score", high)).cast("long").alias("high"), F.lit(negatives).alias("most"))
    found = lists.all(asks, negatives).select("anchor", "slot", F.col("score").alias("negative_score"), F.col("id").alias("negative"), "rank")
    ids = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    told = found.join(near, ["anchor", "slot"]).join(ids, "anchor")
    known = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    return told.select("anchor_id", known("id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative").alias("negative_id"), F.col("score").alias("positive_score"), "negative_score")
