"""Language identification by multilingual mixture inference.

A document is a mixture of languages.  Each language has a distribution over hashed byte trigrams, learned from labelled
documents.  Expectation-maximisation estimates each document's proportions from the trigrams' likelihoods, and a
penalised likelihood selects its set of languages.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

CODE_BITS = 15
UNDETERMINED = "und"
_random = np.random.default_rng(20240229)
#: One random code for each byte at each of the three places of a trigram.
_PLACE = _random.integers(0, 1 << CODE_BITS, size=(3, 256), dtype=np.uint16)
#: ASCII that is not a letter counts as a space.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def codes(text: str) -> np.ndarray:
    """Codes of the trigrams of a text, spaces around it included, runs of spaces left out."""
    raw = _FOLD[np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)]
    space = raw == 32
    raw = raw[~(space & np.concatenate([[False], space[:-1]]))]
    if len(raw) < 3:
        return np.zeros(0, dtype=np.uint16)
    return _PLACE[0][raw[:-2]] ^ _PLACE[1][raw[1:-1]] ^ _PLACE[2][raw[2:]]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def proportions(p: np.ndarray, weight: np.ndarray | None, rounds: int) -> tuple[np.ndarray, float]:
    """EM over the columns of p (likelihood of each trigram in each language): proportions and log likelihood."""
    n = float(len(p) if weight is None else weight.sum())
    pi = np.full(p.shape[1], 1 / p.shape[1], dtype=np.float32)
    for _ in range(rounds if p.shape[1] > 1 else 0):
        inverse = 1 / (p @ pi)
        if weight is not None:
            inverse *= weight
        pi = pi * (inverse @ p) / np.float32(n)
    logs = np.log(p @ pi)
    return pi.astype(np.float64), float(logs.sum(dtype=np.float64) if weight is None else logs @ weight.astype(np.float64))


def infer(text: str, table: np.ndarray, rounds: int, penalty: float, least: float) -> list[tuple[int, float]]:
    """The document's languages with their proportions, largest first.

    Nested sets of the languages with the largest proportions are compared by log likelihood less ``penalty`` times the
    logarithm of the number of trigrams for each further language; a language with less than ``least`` never counts.
    """
    at = codes(text)
    if not len(at):
        return [(0, 1.0)]
    if len(at) > 2 << CODE_BITS:  # no more rows than codes, however long the text is
        count = np.bincount(at, minlength=1 << CODE_BITS)
        at = np.flatnonzero(count)
        p, weight = table[at], count[at].astype(np.float32)
    else:
        p, weight = table[at], None
    pi, _ = proportions(p, weight, rounds)
    order = np.argsort(-pi, kind="stable")
    n = len(at) if weight is None else int(weight.sum())
    best, chosen = -math.inf, [(int(order[0]), 1.0)]
    for k in range(1, len(order) + 1):
        if k > 1 and pi[order[k - 1]] < least:
            break
        own, ll = proportions(np.ascontiguousarray(p[:, order[:k]]), weight, rounds)
        if (value := ll - penalty * (k - 1) * math.log(n + 1)) <= best:
            break
        best, chosen = value, sorted(zip(map(int, order[:k]), map(float, own), strict=True), key=lambda x: -x[1])
    return chosen


def fit(labelled: DataFrame, per_language: int = 2000, smoothing: float = 0.5, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages in natural order, and the likelihood of each trigram code in each of them (rows scaled to a largest value of 1).

    ``per_language`` bounds the sample of labelled rows: of each language about so many rows are learned from, those with
    the smallest hashes of their ids, with their whole texts.  Rows with a null text, language or id are left out.
    """
    rows = labelled.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("i is not null and t is not null and l is not null")
    counts = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    langs = sorted(counts)
    if not langs:
        return [], np.zeros((1 << CODE_BITS, 0), dtype=np.float32)
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / counts[k]))]), F.col("l"))
    place = {k: i for i, k in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(place), 1 << CODE_BITS), dtype=np.int64)
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[place[lang]] += np.bincount(codes(text), minlength=1 << CODE_BITS)
        at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), pa.array(total[at])], names=["l", "code", "n"])

    sample = rows.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < share * (1 << 30)).select("t", "l")
    table = np.full((1 << CODE_BITS, len(langs)), smoothing)
    got = sample.mapInArrow(count, "l int, code int, n long").groupBy("l", "code").agg(F.sum("n").alias("n")).toPandas()
    table[got["code"].to_numpy(dtype=np.int64), got["l"].to_numpy(dtype=np.int64)] += got["n"].to_numpy()
    table /= table.sum(axis=0)
    return langs, (table / table.max(axis=1, keepdims=True)).astype(np.float32)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], rounds: int = 12, penalty: float = 6.0, least: float = 0.03, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per document: id, lang_pred, score, langs; with ``keep`` all columns of docs stand before the last three.

    ``lang_pred`` is the language with the largest proportion, ``score`` that proportion and ``langs`` the selected set as
    lang:proportion, largest first.  A text that is null or has no letter, and any text if nothing was learned, gives
    ``und``, 0 and an empty set.  Repeated rows give equal results, ids pass through as they are, and an empty table gives
    no rows.
    """
    langs, table = model
    held = docs.sparkSession.sparkContext.broadcast(table)  # 2 ** CODE_BITS rows of one float32 a language
    source = docs if keep else docs.select(id_col, text_col)
    place = source.columns.index(text_col)
    passed = [k for k in range(len(source.columns)) if keep or k != place]

    def run(batches):
        for batch in slices(batches):
            pred, score, sets = [], [], []
            for text in batch.column(place).to_pylist():
                if langs and has_letter(text):
                    got = infer(text, held.value, rounds, penalty, least)
                    pred.append(langs[got[0][0]])
                    score.append(min(1.0, max(0.0, got[0][1])))
                    sets.append(",".join(f"{langs[k]}:{v:.3f}" for k, v in got))
                else:
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    sets.append("")
            columns = [*(batch.column(k) for k in passed), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[k] for k in passed), "lang_pred", "score", "langs"])

    fields = ", ".join(f"`{source.columns[k]}` {source.schema[k].dataType.simpleString()}" for k in passed)
    return source.mapInArrow(run, f"{fields}, lang_pred string, score double, langs string")
