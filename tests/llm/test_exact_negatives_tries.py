"""Exact dedup, hard negatives and the prefix trie against brute force, odd rows included, and their queries against SQL."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftmill.llm import exact, negatives, queries, tries

SMALL = "/root/testdata/sf0.001"


def plain_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        keep, done = max((i for i in ids if i is not None), default=None), False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((str(i), str(keep), len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


TEXTS = [*enumerate(["a", "b", "", "a", None, "c", "a", "é" * 3, "x" * 200_000, "x" * 200_000]), (None, "a"), (None, "zz"), (3, "a"), (9, "q"), (9, "q"), (None, "y"), (None, "y")]


@pytest.mark.parametrize("key", ["hash", "length", "constant"])
def test_exact_copies_with_keys_that_collide(spark, key):
    """A weak key chains texts that differ; results stay those of comparing bytes."""
    df = spark.createDataFrame([(i, t, 7, 1) for i, t in TEXTS], "doc_id long, text string, key int, row int")
    keys = {"hash": F.xxhash64, "length": F.length, "constant": lambda t: F.lit(-5)}
    for capacity in (1 << 20, 2):
        got = exact.exact_copies(df, capacity, keys[key]).collect()
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == plain_exact(TEXTS)
    assert exact.exact_copies(df.limit(0), key=keys[key]).count() == 0


def test_directory_doubles_until_buckets_fit(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 2000).alias("text"))
    rows, index = exact.build_index(docs, capacity=50)
    sizes = index.groupBy("bucket", "depth").count().collect()
    assert rows.count() == 3000 and sum(r["count"] for r in sizes) == 2000 and max(r["count"] for r in sizes) <= 50
    assert len({r["depth"] for r in sizes}) > 1 and len(sizes) > 40


def test_exact_has_no_python_and_one_copy_of_a_hot_text(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    out = exact.exact_copies(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    r = out.where("text_sha256 = sha2('hot', 256)").agg(F.count("*"), F.sum(F.col("kept").cast("int")), F.max("group_size"), F.min("keep_id")).first()
    assert tuple(r) == (3000, 1, 3000, 8997)


def plain_negatives(rows, every):
    own = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for k, (i, v, label) in enumerate(own):
        if i is None or i % every:
            continue
        near = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), math.inf if j is None else j, n, m) for n, (j, w, m) in enumerate(own) if n != k and len(w) == len(v))
        for p in [s for s in near if s[3] == label][:5]:
            kept = [s for s in near if s[3] != label and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]][:5]
            out += [(i, own[p[2]][0], r, own[s[2]][0], -p[0], -s[0]) for r, s in enumerate(kept, 1)]
    return sorted(out, key=str)


def vectors(n, dim, copies):
    rng = np.random.default_rng(2)
    roots = rng.standard_normal((6, dim))
    rows = [(i, [float(np.float32(x)) for x in roots[rng.integers(6)] + rng.standard_normal(dim) * 0.3], int(rng.integers(0, 4))) for i in range(n)]
    return rows + [(n + i, rows[3][1], int(rng.integers(0, 3))) for i in range(copies)]


@pytest.mark.parametrize(("rows", "members", "step"), [(4096, 512, 512), (16, 3, 4)])
def test_hard_negatives(spark, monkeypatch, rows, members, step):
    """Ties, repeated rows, null ids, vectors of other lengths and rows that take no part; also in tiny blocks."""
    for k, v in (("ROWS", rows), ("MEMBERS", members), ("STEP", step)):
        monkeypatch.setattr(negatives, k, v)
    table = vectors(200, 8, 60)
    table += [(1000, None, 1), (1001, [float("nan")] * 8, 1), (1100, [0.0] * 8, 2), (1101, [None] * 8, 2), (None, [0.5] * 8, 1), (1200, [0.1, 0.2], 1), (1201, [0.1, 0.3], 1), (1202, [0.1, 0.2], 2)]
    table += [(1300, [], 1), (1301, [], 1), (1302, [], 2), (100, [0.2] * 8, 3), (100, [0.2] * 8, 3), (1500, [0.3] * 8, None), (1600, [0.3] * 8, 9), (1700, [float("inf")] * 8, 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in table], "vec_id long, embedding array<double>, label int, row int, bound int")
    got = negatives.hard_negatives(df, every=20).collect()
    assert sorted(map(tuple, got), key=str) == plain_negatives(table, 20)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.1], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.hard_negatives(df).count() == 0 and negatives.hard_negatives(df.limit(0)).count() == 0


def test_no_score_exceeds_its_bound():
    rng = np.random.default_rng(1)
    x = np.floor(rng.standard_normal((400, 12)) * 256) * (rng.random((400, 1)) * 3)
    c = negatives.centers(x[:50], 5)
    norm, angle = negatives.angles(x, c)
    own = angle[:50].argmin(axis=1)
    widest = np.array([angle[:50][own == k, k].max(initial=0) for k in range(len(c))])
    b = negatives.bounds(norm, angle, widest)
    for k in range(50):
        assert (x @ x[k] <= b[:, own[k]] * norm[k] * (1 + 1e-9)).all()


def plain_trie(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            convs.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{r}\n{x}".encode()).digest(), (r, x)))
    convs = {c: [y[3] for y in sorted(v, key=lambda y: y[:3])] for c, v in convs.items()}
    new = {}
    for c, v in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        new[c] = tuple(convs.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    members, kids, leaves, saved = {}, {}, {}, {}
    for c, s in new.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    for s in sorted(members, key=len, reverse=True):
        words = len(re.findall("[^\x20\x09-\x0d]+", s[-1][1])) if s else 0
        leaves[s] = sum(leaves[k] for k in kids.get(s, [])) or 1
        saved[s] = (len(members[s]) - 1) * words + sum(saved[k] for k in kids.get(s, []))
    ends = {s: hashlib.sha256(",".join(str(c) for c in sorted(m) if new[c] == s).encode()).hexdigest() for s, m in members.items()}
    return sorted((min(m), len(s), str(min(members[s[:-1]]) if s else None), len(m), len(kids.get(s, [])), leaves[s], saved[s], ends[s]) for s, m in members.items())


def turns():
    rng, rows = random.Random(5), []
    for c in [*range(40), 100, 119, 121, -3, -25, 400, 407]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 7, 9])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", "assistant", None]) if t > 2 else "user", rng.choice(["a", "b b", "c d e", None, "", "x"]) if t > 1 else "hi there"))
    return [*rows, (None, 1, "user", "x"), (7, 1, "user", "a"), (7, 1, "user", "a")]


@pytest.mark.parametrize("settings", [{}, {"shards": 7}, {"segment": 4, "shards": 5}])
def test_prefix_trie(spark, settings):
    """One shard, several that share upper nodes, and conversations cut into segments."""
    df = spark.createDataFrame([(*r, 1, 2) for r in turns()], "conv_id long, turn long, role string, text string, gid int, root int")
    c = F.col("c")
    got = tries.prefix_trie(df, F.crc32(c.cast("string")) % 4, c - c % 20, 3, **settings).collect()
    assert sorted((r[0], r[1], str(r[2]), *r[3:]) for r in got) == plain_trie(turns())


def test_prefix_trie_of_nothing(spark):
    assert tries.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_double_array_finds_what_was_packed_and_nothing_else():
    rng = random.Random(3)
    seqs = sorted({tuple(rng.randrange(30) for _ in range(rng.randint(1, 6))) for _ in range(500)})
    length = np.array([len(s) for s in seqs])
    flat = np.concatenate([np.array(s) for s in seqs])
    trie, codes = tries.pack(np.cumsum(length) - length, length, flat)
    code = dict(zip(flat.tolist(), codes.tolist(), strict=True))
    known = {s[:d] for s in seqs for d in range(1, len(s) + 1)}
    for s in [*seqs, *(tuple(rng.randrange(30) for _ in range(3)) for _ in range(500))]:
        node = 0
        for d, x in enumerate(s, 1):
            node = int(trie.children(np.array([node]), np.array([code[x]]))[0])
            assert (node >= 0) == (s[:d] in known)
            if node < 0:
                break


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_exact_dedup", "op13_conversation_trie"])
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        duck.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    got = queries.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = duck.execute(queries.oracle_sql()[name]).to_arrow_table().select(columns)
    assert sorted(map(str, got.select(columns).toArrow().to_pylist())) == sorted(map(str, want.to_pylist()))
