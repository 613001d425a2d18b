"""Toxicity by a linear-chain conditional random field over tokens with two tags.

A bounded sample of labelled documents gives the features (words and word beginnings) that go with the label; tokens of
toxic documents that have a telling feature are the labelled tokens.  The field is trained on these by maximum likelihood.
Forward-backward marginals of a document's tokens are summed up to a calibrated score, and tokens with a marginal of half
or more are the offending spans.

Most tokens have no known feature and thus all the same potentials: a run of n of them is the n-th power of one 2x2
matrix, taken in closed form.  Marginals stay exact, and the work is that of the tokens with known features.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGINNINGS = (4, 5, 6)
CACHE_ENTRIES = 1_000_000
_PART = re.compile(r"[^\W_]+")


def features(unit: str) -> list[str]:
    """Features of a token: its words and their beginnings, lower case.  A token is a run of anything but white space."""
    out = []
    for word in _PART.findall(unit.lower()):
        out.append(word)
        out += [f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]
    return out


@dataclass
class Field:
    """Weights of features, of a token without any, of the changes 0 to 1, 1 to 0 and 1 to 1, and of the calibration."""

    weights: dict[str, float]
    neutral: float = -4.0
    change: tuple[float, float, float] = (0.0, 0.0, 0.0)
    calibration: tuple[float, float, float] = (-4.0, 0.0, 0.0)
    cache: dict = field(default_factory=dict, repr=False, compare=False)

    def emissions(self) -> "_Emissions":
        if "e" not in self.cache:
            self.cache["e"] = _Emissions(self)
        return self.cache["e"]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "cache"}

    def __setstate__(self, state):
        self.__dict__.update(state, cache={})


class _Emissions(dict):
    """What a token adds for tag 1, kept for tokens seen before; a token without known features adds ``neutral``."""

    def __init__(self, crf: Field):
        super().__init__()
        self.crf = crf

    def __missing__(self, unit: str) -> float:
        known = [w for f in features(unit) if (w := self.crf.weights.get(f)) is not None]
        value = sum(known) + self.crf.neutral if known else math.nan
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[unit] = value
        return value


def _power(neutral: float, change: tuple[float, float, float]):
    """n-th power of the matrix of a neutral token, up to a factor: first + ratio ** n * second, and the factor's logarithm for each token."""
    a, b, c, d = 1.0, math.exp(change[0] + neutral), math.exp(change[1]), math.exp(change[2] + neutral)
    half, root = (a + d) / 2, math.sqrt((a - d) ** 2 / 4 + b * c)
    big, small = half + root, half - root
    m = np.array([[a, b], [c, d]])
    first = (m - small * np.eye(2)) / (big - small)
    return first, np.eye(2) - first, small / big, math.log(big)


def marginals(crf: Field, gaps: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Probability of tag 1 at each token with known features.  gaps: neutral tokens before each and after the last."""
    first, second, ratio, _ = _power(crf.neutral, crf.change)
    step = first[None] + (ratio ** gaps)[:, None, None] * second[None]
    change = np.exp(np.array([[0.0, crf.change[0]], [crf.change[1], crf.change[2]]]))
    n = len(scores)
    forward, backward = np.empty((n, 2)), np.empty((n, 2))
    a = np.array([1.0, 0.0])  # before the first token the tag counts as 0
    for k in range(n):
        a = (a @ step[k]) @ change
        a[1] *= math.exp(min(50.0, scores[k]))
        a /= a.sum()
        forward[k] = a
    b = step[n] @ np.ones(2)
    for k in range(n - 1, -1, -1):
        backward[k] = b / b.sum()
        b = np.array([1.0, math.exp(min(50.0, scores[k]))]) * backward[k]
        b = step[k] @ (change @ b)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


def tag(crf: Field, text: str | None) -> tuple[float, list[tuple[int, int]]]:
    """Score of a document and its offending spans (code points, end exclusive)."""
    units = (text or "").split()
    e = np.fromiter(map(crf.emissions().__getitem__, units), dtype=np.float64, count=len(units))
    at = np.flatnonzero(~np.isnan(e))
    p = marginals(crf, np.diff(np.concatenate([[-1], at, [len(units)]])) - 1, e[at]) if len(at) else np.zeros(0)
    score = calibrated(crf.calibration, p)
    bad = set(at[p >= 0.5].tolist())
    spans = [m.span() for k, m in enumerate(re.finditer(r"\S+", text)) if k in bad] if bad else []
    return score, spans


def summary(p: np.ndarray) -> tuple[float, float]:
    return (math.log1p(float(p.sum())), float(p.max())) if len(p) else (0.0, 0.0)


def calibrated(c: tuple[float, float, float], p: np.ndarray) -> float:
    total, most = summary(p)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * total + c[2] * most))))


def _likelihood(xs: list[tuple[np.ndarray, np.ndarray]], neutral: float, change: tuple[float, float, float]) -> tuple[float, list[np.ndarray]]:
    """Log partition functions, summed, and the marginals, of documents with equally many known tokens a batch: (gaps, scores), a row a document."""
    first, second, ratio, each = _power(neutral, change)
    move = np.exp(np.array([[0.0, change[0]], [change[1], change[2]]]))
    total, out = 0.0, []
    for gaps, scores in xs:
        step = first + (ratio**gaps)[..., None, None] * second
        d, n = scores.shape
        forward, a = np.empty((d, n, 2)), np.tile([1.0, 0.0], (d, 1))
        rise = np.exp(np.minimum(scores, 50.0))
        for k in range(n):
            a = np.einsum("di,dij->dj", a, step[:, k]) @ move
            a[:, 1] *= rise[:, k]
            s = a.sum(axis=1)
            total += np.log(s).sum()
            a /= s[:, None]
            forward[:, k] = a
        b = step[:, n].sum(axis=2)
        total += np.log((a * b).sum(axis=1)).sum() + each * gaps.sum()
        p = np.empty((d, n))
        for k in range(n - 1, -1, -1):
            both = forward[:, k] * b
            p[:, k] = both[:, 1] / both.sum(axis=1)
            b = b * np.stack([np.ones(d), rise[:, k]], axis=1) @ move.T
            b = np.einsum("dij,dj->di", step[:, k], b)
            b /= b.sum(axis=1, keepdims=True)
        out.append(p)
    return float(total), out


def train_field(docs: list[tuple[bool, list[int], list[list[str]]]], telling: set[str], rounds: int = 30, rate: float = 0.3, decay: float = 0.01) -> Field:
    """Maximum likelihood, with a quadratic penalty, by gradient ascent with momentum and adapted steps.

    A document is its label, the gaps of neutral tokens and the known features of its other tokens."""
    names = sorted({f for _, _, tokens in docs for t in tokens for f in t})
    index = {f: k for k, f in enumerate(names)}
    by_length: dict[int, list] = {}
    for toxic, gaps, tokens in docs:
        by_length.setdefault(len(tokens), []).append((toxic, gaps, tokens))
    batches, seen = [], np.zeros(3)
    for n, rows in sorted(by_length.items()):
        gaps = np.array([g for _, g, _ in rows], dtype=np.float64).reshape(len(rows), n + 1)
        y = np.array([[toxic and any(f in telling for f in t) for t in tokens] for toxic, _, tokens in rows], dtype=bool).reshape(len(rows), n)
        flat = [(d, k, index[f]) for d, (_, _, tokens) in enumerate(rows) for k, t in enumerate(tokens) for f in t]
        batches.append((gaps, y, np.array(flat, dtype=np.int64).reshape(-1, 3)))
        for d in range(len(rows)):
            last = 0
            for k in range(n):  # changes of the labelled tags; neutral tokens have tag 0
                before = last if gaps[d, k] == 0 else 0
                seen[1] += last == 1 and gaps[d, k] > 0
                seen += [before == 0 and y[d, k], before == 1 and not y[d, k], before == 1 and y[d, k]]
                last = int(y[d, k])
            seen[1] += last == 1 and gaps[d, n] > 0
    w, other = np.zeros(len(names)), np.array([-4.0, 0.0, 0.0, 0.0])
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    size = max(1, sum(len(b[1]) for b in batches))

    def scored(w: np.ndarray, other: np.ndarray):
        xs = []
        for gaps, y, flat in batches:
            s = np.full(y.shape, other[0])
            np.add.at(s, (flat[:, 0], flat[:, 1]), w[flat[:, 2]])
            xs.append((gaps, s))
        return _likelihood(xs, float(other[0]), tuple(other[1:]))

    hits, more = sum(int(y.sum()) for _, y, _ in batches), [0.0] * 4
    for step in range(1, rounds + 1):
        z, ps = scored(w, other)
        g = np.zeros_like(w)
        for (gaps, y, flat), p in zip(batches, ps, strict=True):
            np.add.at(g, flat[:, 2], (y - p)[flat[:, 0], flat[:, 1]])
        for k in range(4) if step % 3 == 1 else ():  # the four others by differences, anew in every third round
            moved = other.copy()
            moved[k] += 1e-4
            more[k] = (hits if k == 0 else seen[k - 1]) - (scored(w, moved)[0] - z) / 1e-4
        grad = np.concatenate([g, more]) / size - decay * np.concatenate([w, other]) / size
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, other = w + move[:-4], other + 0.3 * move[-4:]
    return Field(dict(zip(names, w.tolist(), strict=True)), float(other[0]), tuple(float(x) for x in other[1:]))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float, float]:
    """Weighted logistic regression by Newton's method, with a small penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * weight.sum() / len(weight) * np.eye(3)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-3 * weight.sum() / len(weight) * c)
        c = c + np.clip(step, -2, 2)
    return tuple(float(v) for v in c)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 3000, most_features: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field | None:
    """Train on the documents that labels mark; None if either class is missing.

    ``per_class`` bounds the sample: of each class about so many labelled documents are learned from, with their whole
    texts, those with the smallest hashes of their ids.  Labels that are null or neither 0 nor 1 are left out.
    """
    marked = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)").distinct()
    counts = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    share = {y: min(1.0, per_class / n) for y, n in counts.items()}
    limit = F.when(F.col("y") == 1, share[1]).otherwise(share[0]) * (1 << 30)
    ids = marked.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < limit)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").join(F.broadcast(ids), "i").select("t", "y")

    def count(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for unit in set(text.split()) for f in features(unit)}:
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["f", "n0", "n1"])

    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    table = rows.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n1 >= 5")
    odds = F.log((F.col("n1") + 0.5) / (sizes[1] - F.col("n1") + 0.5)) - F.log((F.col("n0") + 0.5) / (sizes[0] - F.col("n0") + 0.5))
    spread = F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    best = table.withColumns({"odds": odds, "z": odds / spread}).where("odds > 1 and z > 2").orderBy(F.desc("z"), "f").limit(most_features).collect()
    known, telling = {r["f"] for r in best}, {r["f"] for r in best if r["odds"] > 3 and r["z"] > 3}

    def known_tokens(batches):
        for batch in batches:
            ys, gaps, tokens = [], [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own, n = ([], []), 0
                for unit in text.split():
                    if found := [f for f in features(unit) if f in known]:
                        own[0].append(n)
                        own[1].append(found)
                        n = 0
                    else:
                        n += 1
                ys.append(y)
                gaps.append([*own[0], n])
                tokens.append(own[1])
            yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(gaps, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.list_(pa.string())))], names=["y", "gaps", "tokens"])

    sample = [(bool(r["y"]), r["gaps"], r["tokens"]) for r in rows.mapInArrow(known_tokens, "y int, gaps array<long>, tokens array<array<string>>").collect()]
    crf = train_field(sample, telling)
    x = []
    for _, gaps, tokens in sample:
        scores = np.array([sum(crf.weights[f] for f in t) + crf.neutral for t in tokens])
        x.append(summary(marginals(crf, np.array(gaps), scores) if len(scores) else scores))
    y = np.array([t for t, _, _ in sample], dtype=np.float64)
    crf.calibration = calibrate(np.array(x), y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return crf


def score(docs: DataFrame, crf: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score and spans (array of structs start, end of offending tokens, code points).

    A null or empty text gets the score of a text without known features; without a field every score is 0.  Repeated rows
    give equal results, ids pass through, other columns are ignored, and an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(crf)  # at most most_features weights
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            got = [tag(held.value, x) if held.value else (0.0, []) for x in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.float64()), pa.array(spans, kind)], names=[id_col, "score", "spans"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, score double, spans array<struct<start:long,end:long>>")
