"""SentencePiece N-best encoding, and decoding.

A text's pieces form a lattice.  Forward Viterbi scores, the best from the start to each place, are exact heuristics for a
backward A-star search, which therefore takes the N best segmentations off its agenda in order.  No piece crosses the
place before a run of white space, a line end or tab, or the place between marks and letters, so the lattice falls into
parts.  The forward pass goes through many parts at once and gives a part's best and second best score; only the few parts
of a text whose second choices cost least are searched, and their N-best lists merged.

The vocabulary file ranks its pieces by merges and has no probabilities.  A piece's score is that of Zipf's law for its
rank, -ln(1 + rank); a character without a piece is spelled in byte pieces at -ln(vocabulary size) - 10 in all.  Scores
are rounded to multiples of 2 ** -20, so that sums are exact.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE_PARTS = 400_000
CACHE_LISTS = 50_000
UNKNOWN_PENALTY = 10.0
#: Scores are whole multiples of 1 / SCALE: sums are exact, and equal segmentations have equal scores.
SCALE = 1 << 20
NEVER = -(1 << 60)
#: Longest parts that are searched many at a time, and how many of them.
LONGEST_TOGETHER = 64
TOGETHER = 4096
#: Documents whose parts are learned together.
SLICE = 512


class Trie:
    """The beginnings of all pieces as numbered nodes, in a hash table in which many are looked up at once."""

    def __init__(self, walk: dict[str, int | None]):
        number = {p: k for k, p in enumerate(walk, 1)} | {"": 0}
        keys = np.array([number[p[:-1]] << 21 | ord(p[-1]) for p in walk], dtype=np.int64)
        bits = (2 * len(keys)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.nodes = np.full(1 << bits, -1, dtype=np.int64), np.full(1 << bits, -1, dtype=np.int32)
        #: The piece that ends at each node, or -1.
        self.ids = np.array([-1, *(-1 if k is None else k for k in walk.values())], dtype=np.int32)
        nodes, place = np.arange(1, len(keys) + 1, dtype=np.int32), self._place(keys)
        while len(keys):
            free = self.keys[place] == -1
            self.keys[place[free]] = keys[free]
            mine = self.keys[place] == keys
            self.nodes[place[mine]] = nodes[mine]
            keys, nodes, place = keys[~mine], nodes[~mine], (place[~mine] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def child(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The nodes that follow by a character each, -1 where there is none."""
        keys = node.astype(np.int64) << 21 | char
        place = self._place(keys)
        found = self.keys[place]
        out = np.where(found == keys, self.nodes[place], -1)
        left = np.flatnonzero((found != keys) & (found != -1))
        while len(left):
            place[left] = (place[left] + 1) & self.mask
            found = self.keys[place[left]]
            hit = found == keys[left]
            out[left[hit]] = self.nodes[place[left[hit]]]
            left = left[~hit & (found != -1)]
        return out


class Pieces:
    """The pieces of a vocabulary file with their scores.  White space stands in them as itself; the mark that the file has for it is no piece and spelled in bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(k).replace(SPACE, " ") for k in range(size)]
        plain = [k for k in range(size) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        first = plain[0]
        self.ids = {names[k]: k for k in plain}
        self.scores = [-round(SCALE * math.log(1 + max(0, k - first))) for k in range(size)]
        self.longest = max(map(len, self.ids))
        self.bytes = {int(names[k][3:5], 16): k for k in range(size) if model.is_byte(k)}
        self.unknown = -round(SCALE * (math.log(size) + UNKNOWN_PENALTY))
        spelled = {k: bytes([b]) for b, k in self.bytes.items()}
        self.spelling = [spelled.get(k, b"") for k in range(size)]
        for k in plain:
            self.spelling[k] = names[k].encode()
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a piece goes on over white space")
        #: Pieces and their beginnings; the latter stand for no id.
        self.walk = {p[:n]: None for p in self.ids for n in range(1, len(p))} | self.ids
        #: What pieces end with.
        self.tails = {p[n:] for p in self.ids for n in range(len(p))}
        self.trie = Trie(self.walk)
        self.score_of = np.array([*self.scores, NEVER], dtype=np.int64)  # the last one is that of -1: no piece
        cuts = "".join(c for c in "\n\t" if not any(c in p and p != c for p in self.ids))
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        marks = {c for p in self.ids for c in p if not c.isalnum() and c != " " and c not in cuts}
        while beside := {c for x in pairs if " " not in x for c in x if c in marks and not set(x) <= marks}:
            marks -= beside
        marks = "".join(re.escape(c) for c in sorted(marks) if c.isascii())
        #: Parts of a text: white space with the marks or the other characters behind it, and cut characters.  No piece goes
        #: from marks to others, over a cut character, or on into white space.
        self.parts = re.compile(f"[{cuts}]| *[{marks}]+| *[^ {marks}{cuts}]+| +")

    def spelled(self, char: str) -> tuple[int, ...]:
        """The byte pieces of a character that is no piece."""
        return tuple(self.bytes[x] for x in char.encode("utf-8", "replace"))

    def best_two(self, text: str) -> tuple[bytes, int, int]:
        """Ids (as bytes) and score of the best segmentation, and the score of the second best, far below any other if there is none.  Of equal ones that with the longest last piece is the best."""
        n, get = len(text), self.walk.get
        first, second, back = [NEVER] * (n + 1), [NEVER] * (n + 1), [0] * (n + 1)
        first[0] = 0
        for a in range(n):
            x, y = first[a], second[a]
            own = [] if text[a] in self.ids else [(a + 1, self.unknown)]
            for b in range(a + 1, n + 1):
                k = get(text[a:b], -1)
                if k == -1:
                    break
                if k is not None:
                    own.append((b, self.scores[k]))
            for b, s in own:
                if x + s > first[b]:
                    second[b] = max(first[b], y + s)
                    first[b], back[b] = x + s, a
                elif x + s > second[b]:
                    second[b] = x + s
        out: list[int] = []
        while n:
            k = self.ids.get(text[back[n] : n])
            out += self.spelled(text[n - 1])[::-1] if k is None else (k,)
            n = back[n]
        return np.array(out[::-1], dtype="<u4").tobytes(), first[-1], second[-1]

    def best_two_of(self, texts: list[str]) -> list[tuple[bytes, int, int]]:
        """``best_two`` of many texts of one length; all of their characters are pieces or else a text goes by itself."""
        w, n = len(texts), len(texts[0])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(w, n).astype(np.int64)
        # edges[length - 1]: the pieces of that length at each place of each text
        edges: list[np.ndarray] = []
        at = np.arange(w * n)
        node = np.zeros(w * n, dtype=np.int32)
        flat = chars.reshape(-1)
        for length in range(1, min(n, self.longest) + 1):
            fits = at % n + length <= n
            at, node = at[fits], node[fits]
            node = self.trie.child(node, flat[at + length - 1])
            there = node >= 0
            at, node = at[there], node[there]
            if not len(at):
                break
            found = np.full(w * n, -1, dtype=np.int32)
            found[at] = self.trie.ids[node]
            edges.append(np.ascontiguousarray(found.reshape(w, n).T))
        odd = (edges[0] < 0).any(axis=0) if edges else np.ones(w, dtype=bool)
        first, second = np.full((n + 1, w), NEVER, dtype=np.int64), np.full((n + 1, w), NEVER, dtype=np.int64)
        back = np.zeros((n + 1, w), dtype=np.int64)
        first[0] = 0
        for b in range(1, n + 1):
            x, y = first[b], second[b]
            for length in range(min(b, len(edges)), 0, -1):
                s = self.score_of[edges[length - 1][b - length]]
                new, other = first[b - length] + s, second[b - length] + s
                better = new > x
                np.maximum(y, np.where(better, np.maximum(x, other), new), out=y)
                back[b] = np.where(better, length, back[b])
                np.maximum(x, new, out=x)
        ids, here, every = np.full((w, n), -1, dtype=np.int32), np.full(w, n), np.arange(w)
        pieces = np.stack(edges) if edges else np.zeros((1, n, w), dtype=np.int32)
        for b in range(n, 0, -1):
            own = every[(here == b) & ~odd]
            length = back[b][own]
            ids[own, b - length] = pieces[length - 1, b - length, own]
            here[own] = b - length
        used = ids >= 0
        raw, ends = ids[used].astype("<u4").tobytes(), (4 * np.cumsum(used.sum(axis=1))).tolist()
        out = list(zip([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], first[n].tolist(), second[n].tolist(), strict=True))
        for k in np.flatnonzero(odd).tolist():
            out[k] = self.best_two(texts[k])
        return out

    def edges(self, text: str, at: int) -> list[tuple[int, tuple[int, ...], int]]:
        """The edges that end at a place of a text: where they begin, their ids and score."""
        out: list = [] if text[at - 1] in self.ids else [(at - 1, self.spelled(text[at - 1]), self.unknown)]
        for a in range(at - 1, -1, -1):
            if (part := text[a:at]) not in self.tails:
                break
            if (k := self.ids.get(part)) is not None:
                out.append((a, (k,), self.scores[k]))
        return out


def n_best(pieces: Pieces, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The n best segmentations of a text with their scores, best first.

    The forward pass gives the best score from the start to each place.  The search goes backward from the end; what it has
    lost so far against the best segmentation orders its agenda, and as scores are whole numbers a best path loses exactly 0.
    Of the ways from a place to the end only the n best can be part of the n best segmentations, so a place is left after n.
    """
    best, get = [NEVER] * (len(text) + 1), pieces.walk.get
    best[0] = 0
    for a in range(len(text)):
        x = best[a]
        if text[a] not in pieces.ids:
            best[a + 1] = max(best[a + 1], x + pieces.unknown)
        for b in range(a + 1, len(text) + 1):
            k = get(text[a:b], -1)
            if k == -1:
                break
            if k is not None and x + pieces.scores[k] > best[b]:
                best[b] = x + pieces.scores[k]
    out: list[tuple[int, tuple[int, ...]]] = []
    visits = [0] * (len(text) + 1)
    agenda: list[tuple] = [(0, len(text), 0, None)]
    count = 0
    while agenda and len(out) < n:
        lost, at, _, path = heapq.heappop(agenda)
        if visits[at] == n:
            continue
        visits[at] += 1
        if at == 0:
            ids: list[int] = []
            while path is not None:
                ids.extend(path[0])
                path = path[1]
            out.append((best[-1] - lost, tuple(ids)))
            continue
        for a, ids, s in pieces.edges(text, at):
            count += 1
            heapq.heappush(agenda, (lost + best[at] - best[a] - s, a, count, (ids, path)))
    return out


class Encoder:
    """N-best segmentations of whole texts; a bounded cache holds those of parts."""

    def __init__(self, path: str, n: int):
        self.pieces, self.n = Pieces(path), n
        #: Best ids of a part as bytes, their score, and how much worse the second best is.
        self.known: dict[str, tuple[bytes, int, int]] = {}
        self.lists: dict[str, list[tuple[int, bytes]]] = {}

    def learn(self, texts: list[str]) -> list[list[str]]:
        """The parts of texts; those that are not in the cache are put there, the ones of equal length together."""
        if len(self.known) > CACHE_PARTS:
            self.known.clear()
        splits = [self.pieces.parts.findall(" " + text) if text else [] for text in texts]
        new = set().union(*splits).difference(self.known)
        by_length: dict[int, list[str]] = {}
        for p in new:
            by_length.setdefault(len(p), []).append(p)
        for length, parts in by_length.items():
            if length > LONGEST_TOGETHER:
                found = map(self.pieces.best_two, parts)
            else:
                found = (x for i in range(0, len(parts), TOGETHER) for x in self.pieces.best_two_of(parts[i : i + TOGETHER]))
            self.known.update((p, (ids, best, best - second)) for p, (ids, best, second) in zip(parts, found, strict=True))
        return splits

    def list_of(self, text: str) -> list[tuple[int, bytes]]:
        """The n best segmentations of a part, the one that ``best_two`` gives first."""
        if (got := self.lists.get(text)) is None:
            if len(self.lists) > CACHE_LISTS:
                self.lists.clear()
            best, total, _ = self.known[text]
            found = [(s, np.array(ids, dtype="<u4").tobytes()) for s, ids in n_best(self.pieces, text, self.n)]
            got = self.lists[text] = [(total, best), *(x for x in found if x[1] != best)][: self.n]
        return got

    def encode(self, texts: list[str]) -> list[list[tuple[float, bytes]]]:
        """Scores and ids (little-endian unsigned 32 bits) of the n best segmentations of each text; an empty text has one, without ids."""
        return [self.merge(parts) if parts else [(0.0, b"")] for parts in self.learn(texts)]

    def merge(self, parts: list[str]) -> list[tuple[float, bytes]]:
        """The n best segmentations of a text of known parts."""
        rows = list(map(self.known.__getitem__, parts))
        base, scores, costs = map(list, zip(*rows, strict=True))
        total = sum(scores)
        out = [(total / SCALE, b"".join(base))]
        # the n - 1 next best change only parts whose second choices cost least: take them by sums of costs, least first
        near = [(costs[k], k) for k in sorted(range(len(costs)), key=costs.__getitem__)[: self.n - 1] if costs[k] < -NEVER // 2]
        agenda = [(near[0][0], ((0, 1),))] if near else []
        lists = [self.list_of(parts[k]) for _, k in near]
        cost = lambda i, c: lists[i][0][0] - lists[i][c][0]
        while agenda and len(out) < self.n:
            worse, choice = heapq.heappop(agenda)
            own = base.copy()
            for i, c in choice:
                own[near[i][1]] = lists[i][c][1]
            out.append(((total - worse) / SCALE, b"".join(own)))
            i, c = choice[-1]
            rest = choice[:-1]
            if c + 1 < len(lists[i]):
                heapq.heappush(agenda, (worse - cost(i, c) + cost(i, c + 1), (*rest, (i, c + 1))))
            if i + 1 < len(near):
                heapq.heappush(agenda, (worse + cost(i + 1, 1), (*choice, (i + 1, 1))))
                if c == 1:
                    heapq.heappush(agenda, (worse - cost(i, 1) + cost(i + 1, 1), (*rest, (i + 1, 1))))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces and bytes joined, without the space put before the text."""
        spelling = self.pieces.spelling
        raw = b"".join([spelling[k] for k in np.frombuffer(ids, dtype="<u4").tolist()])
        return raw.decode("utf-8", "replace").removeprefix(" ")


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, n: int) -> Encoder:
    if (path, n) not in _ENCODERS:
        _ENCODERS[path, n] = Encoder(path, n)
    return _ENCODERS[path, n]


def segment(docs: DataFrame, path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and segmentation: id, rank (from 0), score and ids (array of int).

    A null text counts as empty and has one segmentation without ids.  A text's own U+2581 is spelled in bytes.  Repeated rows
    give equal rows, ids pass through, other columns are ignored, an empty table gives no rows.
    """

    def run(batches):
        own = encoder(path, n)
        for batch in batches:
            for part in (batch.slice(i, SLICE) for i in range(0, len(batch), SLICE)):
                at, rank, score, ids = [], [], [], []
                for k, found in enumerate(own.encode([x or "" for x in part.column(1).to_pylist()])):
                    for r, (s, raw) in enumerate(found):
                        at.append(k)
                        rank.append(r)
                        score.append(s)
                        ids.append(np.frombuffer(raw, dtype="<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array(score, pa.float64()), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "rank", "score", "ids"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, rank int, score double, ids array<int>")


def round_trip(docs: DataFrame, path: str, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass, one row per document: id, n_tokens, ids_sha256 and score of the best segmentation, scores of all (six decimals, joined by commas), decoded_sha256 (of what all of them decode to; null if they differ) and same (whether that is the text)."""

    def run(batches):
        own = encoder(path, n)
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, len(b), SLICE)):
            out, source = [], [x or "" for x in batch.column(1).to_pylist()]
            for text, got in zip(source, own.encode(source), strict=True):
                texts = {own.decode(ids) for _, ids in got}
                back = texts.pop() if len(texts) == 1 else None
                digest = None if back is None else hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()
                out.append((len(got[0][1]) // 4, hashlib.sha256(got[0][1]).hexdigest(), got[0][0], ",".join(f"{s:.6f}" for s, _ in got), digest, back == text))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=[id_col, "n_tokens", "ids_sha256", "score", "scores", "decoded_sha256", "same"])

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_tokens long, ids_sha256 string, score double, scores string, decoded_sha256 string, same boolean")
