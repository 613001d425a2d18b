"""Operators on text against plain versions, with the odd cases of their docstrings."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siftmill import tables
from siftmill.llm import chat, langid, media, packing, pieces, pii, repeats, simhash, suffixes, toxicity

DOCS = "doc_id long, text string"
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [(None, "abc def ghi"), (1, None), (2, ""), (3, "x" * 30000), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (6, " \t\n"), (7, "é😀 ü")]


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    rows = [(*r, 1, "x", 0.5) for r in ODD]
    return spark.createDataFrame(rows, DOCS + ", n_bytes int, score string, base double")


def none(spark):
    return spark.createDataFrame([], DOCS)


# personal data

PLAIN = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_pii(text):
    def passes(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(x) <= 255 for x in hit.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1])) % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    found = [(m.start(), n, m.end(), kind) for n, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


def test_pii_base_spans(spark):
    rng = random.Random(4)
    bits = ["a", "B", "@", ".", "-", " ", "+", "(", ")", "1", "2", "5", "0", "9", "%", "_", "é", "x@y.zz", "4111111111111111", "192.168.1.1", "+1 (202) 555-0101", "\U0001f600", "@b.c", "0255.1.2.3"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randint(0, 50)))) for k in range(1500)]
    rows += [(-1, None), (-2, "a" * 50000), (-3, "1" * 50000), (-4, "1." * 20000), (-5, "a@b" + ".c" * 20000), (-6, "1 " * 20000)]
    got = spark.createDataFrame(rows, DOCS).select("text", pii.written(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    assert [r for r in got if r.s != plain_pii(r.text)] == []


def test_pii_adds_secrets_and_masks(spark):
    rows = [(k, f'the token = "{hashlib.sha1(str(k).encode()).hexdigest()}" of it') for k in range(20)] + [(50, "mail a@b.cc or call"), (51, "2024-01-02-2024-01-03 alone"), (52, None), (None, "")]
    found = pii.find(spark.createDataFrame(rows, DOCS))
    extra = {r.doc_id: [(x.kind, x.start, x.end) for x in r.extra] for r in found.collect()}
    assert extra[3] == [("secret", 13, 53)] and extra[50] == [] and extra[51] == [] and extra[52] == []
    masked = pii.annotate(spark.createDataFrame(rows, DOCS)).select("doc_id", pii.masked(F.coalesce("text", F.lit("")), F.col("base"), F.col("extra")).alias("m"))
    texts = {r.doc_id: r.m for r in masked.collect()}
    assert texts[50] == "mail <email> or call" and texts[3] == 'the token = "<secret>" of it' and texts[52] == ""
    assert "Python" not in masked._jdf.queryExecution().executedPlan().toString()
    assert pii.find(none(spark)).count() == 0 and pii.find(odd(spark)).count() == len(ODD)


def test_pii_names_addresses_and_long_keys(spark):
    """Names and addresses are told from other capitalised words; keys have no longest form."""
    rows = [(k, f"the contact Anna Smith{k % 7 * 'x'} of it lives at {k + 1} Elm Street and so on") for k in range(30)]
    rows += [(100 + k, f"In the Big House of {k + 1} Green Apples nobody sang.") for k in range(30)]
    rows += [(200 + k, f'the token = "{hashlib.sha512(str(k).encode()).hexdigest()}{"0a" * 80}" of it') for k in range(20)]
    found = {r.doc_id: [(x.kind, x.start, x.end) for x in r.extra] for r in pii.find(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[0] == [("address", 38, 50), ("person", 12, 22)] and found[103] == [] and found[200] == [("secret", 13, 301)]


# toxicity


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = lambda bad: " ".join(rng.choice(words) for _ in range(40)) + (f" You zorkel{rng.choice(words)}, blarg! " if bad else " ") + " ".join(rng.choice(words) for _ in range(9))
    rows = [(k, text(k % 3 == 0)) for k in range(600)]
    docs, labels = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(0, 400)] + [(401, None), (None, 1), (402, 7)], "doc_id long, toxic int")
    crf = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, crf).collect()}
    assert all((got[k].score >= 0.3) == (k % 3 == 0) for k in range(400, 600))
    spans = [rows[402][1][s.start : s.end] for s in got[402].spans]
    assert any(s.startswith("zorkel") for s in spans)
    odd_rows = toxicity.score(odd(spark), crf).collect()
    assert len(odd_rows) == len(ODD) and all(0 <= r.score <= 1 for r in odd_rows)
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and toxicity.score(none(spark), crf).count() == 0
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}


def test_marginals_are_those_of_all_paths():
    crf = toxicity.Field({}, neutral=-1.3, change=(0.4, -0.2, 0.9))
    gaps, scores = np.array([2, 0, 1]), np.array([0.7, -0.5])
    emission = [-1.3, -1.3, 0.7, -0.5, -1.3]
    change = {(0, 0): 0.0, (0, 1): 0.4, (1, 0): -0.2, (1, 1): 0.9}
    total, own = 0.0, [0.0, 0.0]
    for path in itertools.product((0, 1), repeat=5):
        w = np.exp(sum(e for e, y in zip(emission, path, strict=True) if y) + sum(change[a, b] for a, b in zip((0, *path), path, strict=False)))
        total += w
        for k, at in enumerate((2, 3)):
            own[k] += w * path[at]
    assert np.allclose(toxicity.marginals(crf, gaps, scores), np.array(own) / total)


# near-duplicates


def plain_fingerprint(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words)] if 0 < len(words) < width else [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_and_bk_tree():
    rng = random.Random(1)
    for _ in range(60):
        text = " ".join(rng.choice(["a", "B", "ce", "É", "x"]) for _ in range(rng.randint(0, 30)))
        assert simhash.fingerprint(text, 3) == plain_fingerprint(text)
    values = [rng.getrandbits(12) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.search(v, 3)) == [k for k, x in enumerate(values) if (x ^ v).bit_count() <= 3]


@pytest.mark.parametrize("tile", [2000, 7])
def test_simhash_links(spark, tile):
    rng = random.Random(5)
    roots = [rng.getrandbits(64) for _ in range(12)]
    values = sorted({r ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for r in roots for _ in range(15)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    classes = spark.createDataFrame([(v, k) for k, v in enumerate(signed)], "fp long, id long")
    parent = list(range(len(values)))
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in itertools.combinations(range(len(values)), 2):
        if (values[a] ^ values[b]).bit_count() <= 3:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.component for r in simhash.components(simhash.links(classes, tile=tile)).collect()}
    assert [got.get(k, k) for k in range(len(values))] == [root(k) for k in range(len(values))]


def test_simhash_odd_rows(spark):
    got = simhash.near_duplicates(odd(spark)).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[1].component_id == by[2].component_id == by[6].component_id == 1 and by[1].fingerprint == "0" * 16
    assert by[5].component_id == 4 and by[None].component_id is None
    assert simhash.near_duplicates(none(spark)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(3, 3), (None, 1), (8, 7)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 7 for k in range(7, 40)}}


# packing


def test_packing(spark):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["the", "cat's", "été", "x9", "!?", "\x1c", "<|endoftext|>"]) for _ in range(rng.randint(0, 90)))) for k in range(200)] + ODD
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = packing.pack(df, WORD, capacity=64, slack=2, carry=5, fan_in=2).collect()
    tokenizer = Tokenizer.from_file(WORD)
    want = []
    for doc, text in rows:
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want += [(str(doc), k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= 1.05 * sum(w[3] for w in want) / 64 + 3
    assert packing.pack(none(spark), WORD).count() == 0


def test_packing_of_a_table_sorted_by_length(spark, monkeypatch):
    """One partition of long and one of short documents, of which two of each kind fill a sequence."""
    monkeypatch.setattr(packing, "DEALT", 500)
    long_, short = "the " * 47, "the " * 15
    df = spark.range(1000, numPartitions=1).select(F.col("id").alias("doc_id"), F.lit(long_).alias("text")).union(spark.range(1000, 2000, numPartitions=1).select(F.col("id"), F.lit(short)))
    got = packing.pack(df, WORD, capacity=64, slack=2).agg(F.count_distinct("sequence_id"), F.sum("length"), F.count("*")).first()
    assert got[2] == 2000 and got[0] <= 1.01 * got[1] / 64


def test_best_fit_takes_the_fullest_bin():
    bins, offsets, fills = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert fills == [10, 10] and bins == [0, 1, 0, 1, 1] and offsets == [0, 0, 6, 5, 8]


# repeated passages


def plain_repeats(texts, window):
    count = collections.Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                mark[k : k + window] = b"\1" * window
        out.append((sum(mark), bytes(c for c, m in zip(t, mark, strict=True) if not m)))
    return out


@pytest.mark.parametrize("group", [2500, 3])
def test_repeated_passages(spark, group):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcé \n") for _ in range(700)) for _ in range(5)]
    rows = []
    for k in range(80):
        text = ""
        for _ in range(rng.randint(0, 4)):
            x, a = rng.choice(base), rng.randint(0, 500)
            text += x[a : a + rng.randint(50, 300)] + rng.choice(["", "a", "xyz"])
        rows.append((k, text))
    rows += [(1000, "a" * 3000), (1001, "ab" * 700), (1002, None), (None, ""), (1003, "a" * 199), (1004, "z" * 200), *rows[:4]]
    got = repeats.cut_repeats(spark.createDataFrame(rows, DOCS), group=group).collect()
    want = plain_repeats([(t or "").encode() for _, t in rows], 200)
    key = lambda x: (str(x[0]), x[1], x[2])
    assert sorted(((r.doc_id, sum(x.end - x.start for x in r.runs), bytes(r.kept)) for r in got), key=key) == sorted(((i, n, k) for (i, _), (n, k) in zip(rows, want, strict=True)), key=key)


def test_repeated_rows_and_one_near_copy(spark):
    """One row of a context is compared, however often the row is there, and a span counts once."""
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh ") for _ in range(700))
    near = text[:350] + "#" + text[351:]
    few = [(1, text), (1, text), (2, near), (None, text[::-1]), (None, text[::-1]), (3, near[::-1])]
    want = {i: kept for (i, _), (_, kept) in zip(few, plain_repeats([t.encode() for _, t in few], 200), strict=True)}
    rows = [(1, text)] * 10_000 + [(2, near)] + [(None, text[::-1])] * 10_000 + [(3, near[::-1])]
    got = repeats.cut_repeats(spark.createDataFrame(rows, DOCS)).groupBy("doc_id", "kept").count().collect()
    assert {r.doc_id: bytes(r.kept) for r in got} == want and sorted(r["count"] for r in got) == [1, 1, 10_000, 10_000]
    spans = repeats.spans_of(spark.createDataFrame([(bytearray(b"k" * 16), text)] * 50, "k binary, text string"), 200).first().spans
    assert len(spans) == len(set(spans))


def test_many_copies_with_one_variant(spark, monkeypatch):
    """Copies that a full bitmap lets through are not compared."""
    rng = random.Random(10)
    passage = "".join(rng.choice("ijklmnop ") for _ in range(420))
    variant = passage[:210] + "#" + passage[211:]
    sides = {k: (f"{k:06} ", f" {k:06}") for k in range(10, 10_010)}
    ends = collections.Counter(a[n:] for a, _ in sides.values() for n in range(8))
    begins = collections.Counter(b[:n] for _, b in sides.values() for n in range(8))
    rows = [(k, a + passage + b) for k, (a, b) in sides.items()] + [(4, variant)]
    want = {k: a[: next(n for n in range(8) if ends[a[n:]] > 1)] + b[next(n for n in range(7, -1, -1) if begins[b[:n]] > 1) :] for k, (a, b) in sides.items()} | {4: "#"}
    monkeypatch.setattr(repeats, "BITMAP_BITS", 6)
    got = repeats.cut_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.doc_id: bytes(r.kept).decode() for r in got} == want


def test_bitmaps_let_few_through(spark):
    rng = np.random.default_rng(6)
    keys = rng.integers(-(1 << 63), 1 << 63, 3000)
    bits = repeats.bitmap(spark.createDataFrame([(int(x),) for x in keys], "at long"), "at")
    assert repeats.in_bitmap(bits, keys).all() and repeats.in_bitmap(bits, rng.integers(-(1 << 63), 1 << 63, 20_000)).mean() < 0.08


def test_rows_without_repeats_are_not_shuffled(spark):
    """And of the tables written on the way to the spans none is left."""
    rng = random.Random(5)
    text = ["".join(rng.choice("abcdefgh ") for _ in range(600)) for _ in range(60)]
    since = tables.mark(spark)
    cut = repeats.cut_repeats(spark.createDataFrame([(k, x) for k, x in enumerate([*text, text[0]])], DOCS))
    assert tables.mark(spark) == since + 1
    hint = cut._jdf.queryExecution().optimizedPlan().toString()
    joined = hint.split("Join", 1)[1]
    assert "Union" in hint.split("Join", 1)[0] and joined.count("MapInArrow") == 2
    assert {r.doc_id: sum(x.end - x.start for x in r.runs) for r in cut.collect()} == {k: 600 * (k in (0, 60)) for k in range(61)}


def test_repeats_keep_characters(spark):
    shared = "é" * 150
    rows = [(1, "x" + shared + "a"), (2, "yy" + shared + "b")]
    for r in repeats.cut_repeats(spark.createDataFrame(rows, DOCS), whole_characters=True).collect():
        bytes(r.kept).decode()
    assert repeats.cut_repeats(none(spark)).count() == 0 and repeats.cut_repeats(odd(spark)).count() == len(ODD)


def test_suffix_array():
    rng = np.random.default_rng(1)
    for _ in range(200):
        t = rng.integers(1, rng.integers(2, 6), rng.integers(0, 60))
        assert suffixes.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda k: t[k:].tolist())
    strings = [bytes(rng.integers(0, 3, 50).astype("u1")) for _ in range(6)] + [b"ab" * 30, b"\0" * 40]
    count = collections.Counter(s[k : k + 12] for s in strings for k in range(len(s) - 11))
    assert [x.tolist() for x in suffixes.repeated(strings, 12)] == [[k for k in range(len(s) - 11) if count[s[k : k + 12]] > 1] for s in strings]


# chats


def test_chat_round_trip(spark):
    rng = random.Random(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<\\s>", "[\\INST]", "a", "é", "\n", "\U0001f600", "<", "[", "/", "s>"]
    rows = [(rng.choice([None, 1, 2, 3]), k, rng.choice(["user", "assistant", None, "as\nsist\\n", "<s>\\"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))])) for k in range(300)]
    want = {}
    for c, _, role, text in rows:
        n, turns, loss = want.get(c, (0, "", ""))
        want[c] = n + 1, turns + f"{role or ''}\n{text or ''}\n", loss + (text or "" if role == "assistant" else "")
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    formatted = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_chats(formatted).collect()}
    assert got == {c: (n, digest(t), len(x), digest(x)) for c, (n, t, x) in want.items()}
    assert chat.read_chats(formatted.limit(0)).count() == 0


# pieces


def test_n_best_is_the_best_of_all():
    own = pieces.Encoder(PIECE, 6)

    def everything(text):
        go = lambda at, s: [s] if at == 0 else [x for a, _, w in own.pieces.edges(" " + text, at) for x in go(a, s + w)]
        return [s / pieces.SCALE for s in sorted(go(len(text) + 1, 0), reverse=True)[:6]]

    rng = random.Random(0)
    for _ in range(150):
        text = "".join(rng.choice(["a", "b", "the", " ", "\n", ".", "é", "\U0001f98a", "in", "\r", "\u2581"]) for _ in range(rng.randint(1, 6)))
        got = own.encode([text])[0]
        assert [s for s, _ in got] == everything(text) and len({ids for _, ids in got}) == len(got)
        assert all(own.decode(ids) == text for _, ids in got)


def test_forward_pass_of_many_is_that_of_each():
    own = pieces.Pieces(PIECE)
    rng = random.Random(1)
    for n in (1, 2, 7, 20, 40):
        texts = ["".join(rng.choice("aaabethinons \u00e9\u4e00\u2581\U0001f98a") for _ in range(n)) for _ in range(60)]
        assert [(i, a, max(b, pieces.NEVER // 2)) for i, a, b in own.best_two_of(texts)] == [(i, a, max(b, pieces.NEVER // 2)) for i, a, b in map(own.best_two, texts)]


@pytest.mark.parametrize("letters", ["ab", "abcdefghijklmnopqrstuvwxyzABCDEFG0123456789", "\u4e00\u3042\u00e9", "a"])
def test_unbroken_text_does_not_hang(letters):
    own = pieces.Encoder(PIECE, 4)
    rng = random.Random(2)
    text = "".join(rng.choice(letters) for _ in range(60_000))
    got = own.encode([text])[0]
    assert len({ids for _, ids in got}) == len(got) and [s for s, _ in got] == sorted((s for s, _ in got), reverse=True)
    assert all(own.decode(ids) == text for _, ids in got)


def test_n_best_agrees_with_the_library():
    """The same pieces and scores in the library's own model with probabilities: its n best segmentations have our scores."""
    import struct

    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(number, raw):
        return varint(number << 3 | 2) + varint(len(raw)) + raw

    own = pieces.Encoder(PIECE, 5)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    kinds = lambda k: 2 if model.is_unknown(k) else 3 if model.is_control(k) else 6 if model.is_byte(k) else 1
    raw = b"".join(field(1, field(1, model.id_to_piece(k).encode()) + b"\x15" + struct.pack("<f", own.pieces.scores[k] / pieces.SCALE) + b"\x18" + bytes([kinds(k)])) for k in range(model.get_piece_size()))
    raw += field(2, b"\x18\x01\x98\x02\x01")  # a model with a probability for each piece, and byte pieces
    raw += field(3, field(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")  # a space before the text, none removed, spaces marked
    library = sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = random.Random(3)
    for _ in range(60):
        text = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 3)))
        theirs = [sum(own.pieces.scores[k] for k in ids) / pieces.SCALE for ids in library.nbest_encode_as_ids(text, 5)]
        ours = own.encode([text])[0]
        assert np.allclose([s for s, _ in ours[:5]], theirs, atol=1e-3), (text, ours, theirs)


def test_pieces_odd_rows(spark):
    got = pieces.round_trip(odd(spark), PIECE).collect()
    assert len(got) == len(ODD) and all(r.same for r in got)
    assert {r.doc_id for r in got if r.same} == {r.doc_id for r in got}
    assert pieces.segment(odd(spark), PIECE).where("rank = 0").count() == len(ODD) and pieces.round_trip(none(spark), PIECE).count() == 0


# languages


def test_language_mixtures(spark):
    rng = random.Random(7)
    kinds = {"aa": ["tha", "ing", "ed", "the"], "bb": ["öck", "sch", "ung", "ein"], "cc": ["çao", "iño", "los", "que"]}
    text = lambda k, n: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(k, text(lang, 60), lang) for k, lang in enumerate(list(kinds) * 30)] + [(900, None, "aa"), (901, "x", None)]
    model = langid.fit(spark.createDataFrame(rows, DOCS + ", lang string"))
    tests = [(1, text("bb", 30)), (2, text("aa", 60) + " " + text("cc", 40)), (3, None), (4, "12 34 !"), (5, ""), (None, text("cc", 300))]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(tests, DOCS), model).collect()}
    assert got[1].lang_pred == "bb" and got[1].langs == "bb:1.000" and got[None].lang_pred == "cc"
    assert [x.split(":")[0] for x in got[2].langs.split(",")] == ["aa", "cc"] and 0.45 < got[2].score < 0.75
    assert {got[k].lang_pred for k in (3, 4, 5)} == {"und"}
    assert langid.identify(odd(spark), model).count() == len(ODD) and langid.identify(none(spark), langid.fit(none(spark).withColumn("lang", F.lit("a")))).count() == 0


def test_chats_read_from_files_in_any_order(spark, monkeypatch, tmp_path):
    """Parts that were written and dealt out anew give what they gave straight from the writer."""
    monkeypatch.setattr(chat, "PART_BYTES", 300)
    rows = [(c, t, ("user", "assistant")[t % 2], f"turn {t} " * (c % 7 + 1)) for c in range(30) for t in range(12)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df)
    made.write.parquet(str(tmp_path / "chats"))
    again = spark.read.parquet(str(tmp_path / "chats")).orderBy(F.rand(3)).repartition(7)
    tell = lambda d: sorted(map(tuple, d.collect()))
    assert again.where("part > 0").count() and tell(chat.read_chats(again)) == tell(chat.read_chats(made, in_order=True))


# media


def test_media_round_trip(spark):
    stored = media.store(odd(spark))
    got = media.inspect(stored).collect()
    texts = collections.Counter((r.n_bytes, r.payload_sha256) for r in got)
    want = collections.Counter()
    for _, text in ODD:
        raw = (text or "").encode()
        want[len(raw), hashlib.sha256(raw.ljust(max(1, -(-len(raw) // 192)) * 192)).hexdigest()] += 1
    assert texts == want and media.inspect(media.store(none(spark))).count() == 0


def test_every_media_column(spark, monkeypatch):
    """Against the texts themselves, around the size from which all of the format is used, and with images of few rows."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    texts = [None, "", "a", "x" * 192, "x" * 193] + [" ".join(rng.choice(words) for _ in range(n)) for n in (30, 1900, 2200, 9000)]
    for most in (media.MOST, 50):
        monkeypatch.setattr(media, "MOST", most)
        for text in texts:
            raw = (text or "").encode()
            payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
            stored = media.to_images(payload)
            assert media.to_images(payload) == stored and media.from_images(stored).tobytes() == payload
    got = {r.doc_id: r for r in media.inspect(media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    monkeypatch.undo()
    for k, text in enumerate(texts):
        raw, r = (text or "").encode(), got[k]
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192)
        stored = media.to_images(payload)
        x = np.frombuffer(payload, dtype=np.uint8).astype(int)
        steps = sum(abs(int(a) - int(b)) for a, b in zip(payload[192:], payload, strict=False)) * 1000 // max(1, len(payload) - 192)
        hist = ",".join(str(sum(b >> 5 == n for b in payload)) for n in range(8))
        feature = f"192x{len(payload) // 192};mean={int(x.sum()) * 1000 // len(x)};var={(int((x * x).sum()) * len(x) - int(x.sum()) ** 2) // len(x) ** 2};step={steps};hist={hist}"
        want = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == want
