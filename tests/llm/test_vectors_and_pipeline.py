"""Vectors against all pairs, the pipeline against a plain version, and the registered queries on the smallest tables."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siftmill.llm import caps, nearcopies, queries, simhash
from siftmill.llm.repeats import within_characters
from test_text_operators import plain_pii, plain_repeats

SMALL = "/root/testdata/sf0.001"


def linked(rows, threshold=0.98):
    """Number of links and component of each row, by all pairs."""
    ok = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, part = [0] * len(rows), list(range(len(rows)))
    root = lambda x: x if part[x] == x else root(part[x])
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=float), np.array(rows[b][1], dtype=float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[a] += 1
                    n[b] += 1
                    part[root(b)] = root(a)
    groups = {}
    for k in range(len(rows)):
        groups.setdefault(root(k), []).append(rows[k][0])
    return sorted(((str(i), n[k], str(min((x for x in groups[root(k)] if x is not None), default=None))) for k, (i, _, _) in enumerate(rows)))


@pytest.mark.parametrize("tile", [1024, 6])
def test_vectors(spark, tile):
    rng = np.random.default_rng(4)
    rows, k = [], 0
    for _ in range(25):
        root = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            v = root + rng.standard_normal(16) * 0.12
            rows.append((k, [float(np.float32(x)) for x in v], int(rng.integers(0, 2))))
            k += 1
    copy = rows[3][1]
    rows += [(1000 + j, copy, rows[3][2]) for j in range(20)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, copy, None), (2005, copy[:8], 1), (2006, [], 1), (None, copy, 1), (2007, [float("inf")] + copy[1:], 1)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, weight int")
    got = caps.link_vectors(df, tile=tile).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == linked(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert caps.link_vectors(df.limit(0)).count() == 0


def test_recall_of_random_pairs():
    """Pairs at the threshold share a filter nearly always."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    both = [set(a.tolist()) & set(b.tolist()) for a, b in zip(caps.decode(x, 7, 16.0, 8), caps.decode(y, 7, 16.0, 8), strict=True)]
    assert np.mean([bool(b) for b in both]) >= 0.99


@pytest.mark.parametrize("size", [7, 64, 256])
def test_recall_of_uneven_vectors(size):
    """Vectors with their energy in few coordinates, a common mean or falling scales meet as often as even ones."""
    rng = np.random.default_rng(5)
    dim = 64
    scales = {"even": np.ones(dim), "third": np.where(np.arange(dim) < dim // 3, 10.0, 1.0), "mean": np.ones(dim), "falling": 0.8 ** np.arange(dim)}
    own, least = caps.measured(dim, size, 0.98)
    for name, scale in scales.items():
        x = rng.standard_normal((300, dim)) * scale
        x[:, 0] += 30 if name == "mean" else 0
        z = rng.standard_normal(x.shape) * scale
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        y = 0.9805 * x + np.sqrt(1 - 0.9805**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
        both = [set(a.tolist()) & set(b.tolist()) for a, b in zip(caps.decode(caps.turned(x), own, 16.0, max(8, least)), caps.decode(caps.turned(y), own, 16.0, max(8, least)), strict=True)]
        assert np.mean([bool(b) for b in both]) >= 0.97, name


@pytest.mark.parametrize("size", [1, 7, 40])
def test_list_decoding_finds_all_filters(size):
    """Against all sums: every filter over the threshold, and where these are too few the best."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    parts = np.array_split(np.arange(12), caps.BLOCKS)
    a, b, c = (x[:, p] @ book.T for p, book in zip(parts, caps.codebooks(12, size), strict=True))
    for expected, least in ((0.5, 3), (16.0, 8), (500.0, 8)):
        limit = caps.NormalDist().inv_cdf(max(0.5, 1 - expected / size**3)) / np.sqrt(12) * np.sqrt(3)
        for k, got in enumerate(caps.decode(x, size, expected, least)):
            total = (a[k][:, None, None] + b[k][None, :, None] + c[k][None, None, :]).reshape(-1)
            over = np.flatnonzero(total >= limit)
            want = over if len(over) >= least else np.sort(np.argsort(-total)[:least])
            assert got.tolist() == want.tolist()


def test_vectors_of_any_magnitude(spark):
    rows = [(k, [s * y for y in (1.0, 2.0, 3.0, 4.0)], 1) for k, s in enumerate((1e-300, 1.0, 1e300, -1.0))]
    got = caps.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3)]


@pytest.mark.parametrize("dim", [2, 16, 64])
@pytest.mark.parametrize("size", [64, 128, 256])
def test_recall_at_each_size(dim, size):
    """Other pairs than the filters were chosen by share one at every size of the codebooks."""
    own, least = caps.measured(dim, size, 0.98)
    x, y = caps.random_pairs(dim, 0.98, 1000, 2)
    both = [len(np.intersect1d(a, b)) > 0 for a, b in zip(caps.decode(x, own, 16.0, max(8, least)), caps.decode(y, own, 16.0, max(8, least)), strict=True)]
    print(f"dim {dim} size {size}: codebooks of {own}, at least {max(8, least)} filters, recall {np.mean(both):.4f}")
    assert np.mean(both) >= 0.99


DOCS = [
    (1, "The cats of the house were sleeping and dreaming near the old stove of the kitchen.", "en"),
    (2, "the cats of the house were sleeping and dreaming near the old stove of the kitchen.", "en"),
    (3, "Mail me at a.b@mail.example.com or +1 (202) 555-0101, and not before the next evening or so.", "en"),
    (4, "12345 !!", None),
    (5, None, "en"),
    (6, "Über die Straße gehen " + "é" * 130 + " und weiter", "de"),
    (7, "Ein anderer Text davor, " + "é" * 130 + " und danach noch etwas", "de"),
    (8, "word " * 60, None),
    (None, "A row without a number is kept if nothing is like it.", "en"),
    (9, "Mail me at a.b@mail.example.com or +1 (202) 555-0101, and not before the next evening or so.", "en"),
]


def plain_pipeline(rows):
    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    words = [t.encode().lower().split() for _, t, _ in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for w in words]
    part = list(range(len(rows)))
    root = lambda x: x if part[x] == x else root(part[x])
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                part[root(a)] = root(b)
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(root(k), []).append((r[0] is None, r[0] or 0, k))
    rows = [rows[min(g)[2]] for g in groups.values()]
    raws = [t.encode() for _, t, _ in rows]
    texts = []
    for raw, (_, kept) in zip(raws, plain_repeats(raws, 200), strict=True):
        texts.append((raw, kept))
    out = []
    count = {}
    for raw in raws:
        for k in range(len(raw) - 199):
            count[raw[k : k + 200]] = count.get(raw[k : k + 200], 0) + 1
    for (doc, _, _), raw in zip(rows, raws, strict=True):
        mark = np.zeros(len(raw) + 2, dtype=int)
        for k in range(len(raw) - 199):
            if count[raw[k : k + 200]] > 1:
                mark[k + 1 : k + 201] = 1
        edges = np.flatnonzero(np.diff(mark)).tolist()
        runs = within_characters(raw, list(zip(edges[::2], edges[1::2], strict=True)))
        kept, at = b"", 0
        for a, b in runs:
            kept += raw[at:a]
            at = b
        text = (kept + raw[at:]).decode()
        masked, at = "", 0
        for s in filter(None, plain_pii(text).split(",")):
            kind, a, b = s.split(":")
            if int(a) >= at:
                masked += text[at : int(a)] + f"<{kind}>"
                at = int(b)
        out.append((doc, masked + text[at:]))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for doc, text in out:
        ids = np.asarray([*tokenizer.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        pieces += [(str(doc), k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(ids[k : k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    return sorted(pieces)


def test_pipeline_is_the_plain_one(spark, tmp_path):
    rows = [(i, t, lang, "s", len(t or ""), 1, "x") for i, t, lang in DOCS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, base string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pipeline(DOCS)


def test_near_dedup_by_similarity_of_five_words(spark, tmp_path):
    """Against all pairs at similarity 0.8; short variants, chains, and texts with one repeated shingle."""
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 5000, n)]
    texts = []
    for _ in range(12):
        root = words(100)
        texts.append(" ".join(root))
        for n in (1, 1, 2, 4, 5, 6):
            copy = list(root)
            for k in rng.choice(100, n, replace=False):
                copy[k] = "changed" + str(rng.integers(0, 10**6))
            texts.append(" ".join(copy))
    texts += [" ".join(["same"] * 400 + words(30)) for _ in range(4)] + ["", "one", "one", "One two"]
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))})
    part = list(range(len(texts)))
    root = lambda x: x if part[x] == x else root(part[x])
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                part[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.simhash_near_dedup(spark, docs, str(tmp_path)).collect()]
    assert sorted(got) == sorted({root(k) for k in part})


def test_near_dedup_stage_links_by_fingerprints(spark, tmp_path):
    """The stage against all pairs of SimHash fingerprints, rows without an id and texts of which fingerprints alone tell that they are near included."""
    rng = np.random.default_rng(8)
    rows = []
    for n in (3, 40, 400, 400, 400):
        root = [f"w{x}" for x in rng.integers(0, 5000, n)]
        rows += [(len(rows), " ".join(root))]
        for k in rng.choice(n, min(n, 6), replace=False):
            rows += [(len(rows), " ".join([*root[:k], "changed", *root[k + 1 :]])), (len(rows) + 1, " ".join(root).upper())]
    rows += [(None, rows[-1][1]), (None, "no other text is like this one"), (None, "No other text is like this one"), (rows[3][0], rows[3][1])]
    fps = [simhash.fingerprint(t, 3) for _, t in rows]
    part = list(range(len(rows)))
    root = lambda x: x if part[x] == x else root(part[x])
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                part[root(a)] = root(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(root(k), []).append((i is None, i or 0))
    far = [(a, b) for a, b in zip(fps, fps[1:], strict=False) if 0 < (a ^ b).bit_count() <= 3]
    assert far and len(groups) < len(rows) - 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    got = [(r.doc_id is None, r.doc_id or 0) for r in stage(spark, docs, str(tmp_path)).collect()]
    assert sorted(got) == sorted(min(g) for g in groups.values())


def test_near_dedup_with_boilerplate(spark):
    """Documents that share most of their words but stay below the similarity make no candidates; copies among them are found."""
    rng = np.random.default_rng(2)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    shared = words(350)
    texts = [" ".join([*words(k % 90), *shared, *words(130 - k % 90)]) for k in range(1500)]
    texts += [texts[k].replace(" w", " x", 1) for k in range(0, 1500, 50)] + [" ".join([*shared, *words(20)]) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("_row", F.col("doc_id"))
    found = {r.doc_id: r.part for r in nearcopies.near_copies(docs).collect()}
    groups = {}
    for k, part in found.items():
        groups.setdefault(part, set()).add(k)
    want = [{k, 1500 + k // 50} for k in range(0, 1500, 50)] + [set(range(1530, 1570))]
    assert sorted(sorted(g) for g in groups.values() if len(g) > 1) == sorted(sorted(g) for g in want)
    pairs = [p for p in spark._siftmill_tables if "siftmill-pairs" in p][-1]
    assert spark.read.parquet(pairs).count() < 5000


def test_order_decides_no_result():
    """Pairs at the similarity share a shingle of their prefixes, whatever counts as common."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 200):
        base = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        for _ in range(50):
            other = np.unique(np.concatenate([rng.permutation(base)[: len(base) - rng.integers(0, max(1, len(base) // 9) + 1)], rng.integers(0, 1 << 60, rng.integers(0, max(1, len(base) // 9) + 1)).astype(np.uint64)]))
            common = np.sort(rng.permutation(base)[: rng.integers(0, len(base) + 1)])
            rank = rng.permutation(len(common))
            both = len(np.intersect1d(base, other))
            if both and both / (len(base) + len(other) - both) >= 0.8:
                assert len(np.intersect1d(nearcopies.prefix(base, common, rank, 0.8), nearcopies.prefix(other, common, rank, 0.8)))


def test_stages_keep_the_columns(spark, tmp_path):
    rows = [(i, t, lang, "s", len(t or ""), 1, "x") for i, t, lang in DOCS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, base string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for part in (docs, docs.limit(0)):
            out = stage(spark, part, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= part.count(), name
    masked = corpus_pipeline.pii(spark, docs, str(tmp_path)).where("doc_id = 3").first()
    assert masked.text.startswith("Mail me at <email> or <phone>,") and masked.n_chars == len(masked.text) and masked.base == "x"


def test_toxicity_of_held_out_documents(spark):
    """Of the labelled documents that were not learned from, those predicted toxic are, and most toxic ones are predicted."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("toxic is not null").select("doc_id", "toxic").distinct()
    got = queries.op2_toxicity_crf(spark, "/root/testdata/sf0.01").where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").toPandas()
    hit = ((got.predicted == 1) & (got.toxic == 1)).sum()
    assert len(got) > 50 and hit >= 0.9 * (got.predicted == 1).sum() and hit >= 0.5 * (got.toxic == 1).sum()


def test_queries_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").toPandas().set_index("doc_id")
    for name, q in queries.queries().items():
        out = q(spark, SMALL)
        n = {"op4": "embeddings", "op7": None, "op5": None, "op11": None, "op13": None}.get(name.split("_")[0], "documents")
        if n:
            assert out.count() == spark.read.parquet(f"{SMALL}/{n}.parquet").count(), name
    spans = {r.doc_id: r for r in queries.op1_pii_weak_supervision(spark, SMALL).collect()}
    for doc, text in docs.text.items():
        base = [s for s in plain_pii(text).split(",") if s]
        assert [s for s in spans[doc].spans.split(",") if re.match("email|ip|card|phone", s)] == base
    guess = queries.op9_language_id(spark, SMALL).where("held_out").toPandas().set_index("doc_id")
    assert (guess.lang_pred == docs.lang[guess.index]).mean() > 0.95
    chats = queries.op7_chat_formatting(spark, SMALL)
    assert chats.where("conv_id = -7 and n_turns = 2 and loss_chars = 21").count() == 1
    assert chats.agg(F.count_distinct("conv_id")).first()[0] == chats.count()
