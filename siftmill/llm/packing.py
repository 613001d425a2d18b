"""Best-fit packing of token sequences by hierarchical residual packing.

Every scan partition tokenises and cuts its documents.  The pieces, light rows without tokens, are dealt out in turn by length, so that
each partition has the whole mix of lengths however the table is sorted, and packs them by best fit, longest first.  Nearly full bins are
final.  Underfull bins go up a tree as items: groups of ``fan_in`` partitions meet, best fit merges their bins, and what
is still underfull goes on, until one group is left.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, grp int, done boolean"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("grp", pa.int32()), ("done", pa.bool_())])
CUT = pa.schema(list(ARROW)[:5])
#: Pieces that a partition of the first level packs, about.
DEALT = 20_000
#: Separators of Python's str.split() that the tokenizer does not take for white space.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")
CACHE_ENTRIES = 300_000
CACHE_WORDS = 400_000
#: Units of which the tokenizer sees each run of letters, digit and run of marks for itself; apostrophes and special tokens are left out.
PLAIN = re.compile("[!-&(-;=-~À-ÖØ-öø-\u012f\u0132-\u017f]+")
WORDS = re.compile("[a-zß-öø-\u012f\u0132-\u017f]+|[0-9]|[!-/:-@\\[-`{-~]+")
WORD_END = "</w>"


class UnitTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, exactly as the tokenizer gives them.

    The tokenizer drops white space and no token spans it, so a text's ids are the ids of its white-space-separated
    units, which are looked up in a bounded cache.  Units not seen before are made of words, most of which are in a second
    bounded cache.  New words reach the tokenizer many at a time: each ends with the only token of it that marks a word's end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache, self.words = Tokenizer.from_file(path), {}, {}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        self.ends[[k for t, k in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            cut = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cut) == len(part) + 1 and cut[-1] == len(ids):
                raw, cut = ids.tobytes(), [4 * x for x in cut]
                self.words.update(zip(part, [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))
            else:
                self.words.update(zip(part, self._ids(part), strict=True))

    def _add(self, units: list[str]) -> None:
        plain, odd = [], []
        for u in units:
            (plain if PLAIN.fullmatch(u) else odd).append(u)
        if odd:
            self.cache.update(zip(odd, self._ids(odd), strict=True))
        made = [WORDS.findall(u.lower()) for u in plain]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        if new := list({w for words in made for w in words}.difference(self.words)):
            self._learn(new)
        get = self.words.__getitem__
        self.cache.update(zip(plain, [get(x[0]) if len(x) == 1 else b"".join(map(get, x)) for x in made], strict=True))

    def forget(self) -> None:
        """Empty both caches."""
        self.cache.clear()
        self.words.clear()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        for text in texts:
            if any(x in text for x in ODD_SPACE):
                yield self._ids([text])[0]
                continue
            units = text.split()
            missing = list(set(units).difference(self.cache))
            if missing:
                if len(self.cache) > CACHE_ENTRIES:
                    self.cache.clear()
                    missing = list(set(units))
                self._add(missing)
            yield b"".join(map(self.cache.__getitem__, units))


_TOKENIZERS: dict[str, UnitTokenizer] = {}


def _tokenizer(path: str) -> UnitTokenizer:
    if path not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = UnitTokenizer(path)
    return _TOKENIZERS[path]


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and each bin's fill; longest first, each into the fullest bin that it fits."""
    bins, offsets, fills = [0] * len(lengths), [0] * len(lengths), []
    free: list[int] = []  # the residuals in use, ascending
    having: dict[int, list[int]] = {}  # bins by residual
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(free, n)
        if at < len(free):
            left = free[at]
            b = having[left].pop()
            if not having[left]:
                del having[left], free[at]
        else:
            b, left = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        left -= n
        if left > 0:
            if left in having:
                having[left].append(b)
            else:
                having[left] = [b]
                insort(free, left)
    return bins, offsets, fills


def _pending(fills: list[int], capacity: int, slack: int, carry: int) -> set[int]:
    """Bins that go up the tree: the emptiest ``carry`` of those with more than ``slack`` tokens free.  Two bins of at most half the capacity never remain beside each other, so all of those that can still meet an equal go up."""
    open_ = sorted((f, b) for b, f in enumerate(fills) if capacity - f > slack)
    return {b for _, b in open_[:carry]}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, slack: int = 16, carry: int = 128, fan_in: int = 8, id_col: str = "doc_id", text_col: str = "text", hold: bool = True) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  A null text counts as empty and an
    empty text is one piece holding ``end_id``; repeated rows are packed each; null ids stay null; an empty table gives no
    rows; other columns are ignored.  Only documents longer than ``capacity`` are cut.  ``carry`` bounds what one group
    hands up, so no task sees more than fan_in * carry bins; the bins not handed up are final.
    With ``hold`` a worker keeps its tokenizer's caches for its next task, otherwise their memory is free for what runs after it.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches):
        tok, at_first = _tokenizer(tokenizer_path), 7919 * TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            ids, piece, start, length, crc = [], [], [], [], []
            texts = (x or "" for part in slices([batch]) for x in part.column(1).to_pylist())
            for doc, raw in zip(batch.column(0).to_pylist(), tok.encode(texts), strict=True):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            deal = np.empty(len(ids), np.int64)
            deal[np.argsort(length, kind="stable")] = at_first + 104_729 * number + np.arange(len(ids))  # neighbours in length go to different partitions
            columns = [pa.array(x, t) for x, t in zip((ids, piece, start, length, crc), CUT.types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(deal)], names=[*CUT.names, "deal"])
        if not hold:
            tok.forget()

    def level0(batches):
        pid, tables = TaskContext.get().partitionId(), [pa.Table.from_batches([b]) for b in batches]
        pieces = pa.concat_tables(tables).select(CUT.names) if tables else CUT.empty_table()
        bins, offsets, fills = best_fit(pieces.column("length").to_pylist(), capacity)
        up = _pending(fills, capacity, slack, carry)
        b = np.asarray(bins, dtype=np.int64)
        yield from pa.Table.from_arrays([*pieces.columns, pa.array(b + (np.int64(pid) << 32)), pa.array(offsets, pa.int64()), pa.array(np.full(len(b), pid, np.int32)), pa.array([x not in up for x in bins], pa.bool_())], schema=ARROW).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        seq = table.column("sequence_id").to_numpy()
        length = table.column("length").to_numpy()
        names, inverse = np.unique(seq, return_inverse=True)
        sizes = np.bincount(inverse, weights=length).astype(np.int64).tolist()
        bins, base, fills = best_fit(sizes, capacity)
        up = _pending(fills, capacity, slack, carry)
        first: dict[int, int] = {}
        for k, b in enumerate(bins):  # a merged bin takes the id of its first member
            first.setdefault(b, int(names[k]))
        to = np.asarray([first[b] for b in bins], dtype=np.int64)[inverse]
        moved = table.column("offset").to_numpy() + np.asarray(base, dtype=np.int64)[inverse]
        done = np.asarray([b not in up for b in bins])[inverse]
        return pa.Table.from_arrays([*(table.column(i) for i in range(5)), pa.array(to), pa.array(moved), table.column("grp"), pa.array(done)], schema=ARROW)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialise(texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"), "pieces")
    parts = max(1, -(-pieces.count() // DEALT))
    rows = materialise(pieces.repartition(parts, F.pmod("deal", F.lit(4 * parts))).mapInArrow(level0, SCHEMA), "pack")
    out = rows.where("done")
    pending = rows.where("not done")
    groups = (pending.agg(F.max("grp")).first()[0] or 0) + 1
    while groups > 1:
        groups = -(-groups // fan_in)
        rows = materialise(pending.withColumn("grp", F.floor(F.col("grp") / fan_in).cast("int")).groupBy("grp").applyInArrow(merge, SCHEMA), "pack")
        out, pending = out.union(rows.where("done")), rows.where("not done")
    return out.union(pending).drop("grp", "done")
