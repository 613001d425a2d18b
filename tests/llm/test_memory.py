"""What the stages hold in a Python worker at once."""

import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers

from siftmill.llm import packing, repeats, suffixes


def test_pools_are_bounded():
    """Whole names of two rows and more, in order, in pools that are not over the bound unless one name is."""
    rng = np.random.default_rng(1)
    rows = [(name, bytes([name % 256]) * 16, k, b"x" * 300) for name, n in enumerate(rng.integers(1, 12, 400).tolist() + [90, 1]) for k in range(n)]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("name", "k", "start", "bytes"), map(list, zip(*rows[i : i + 37], strict=True)), strict=True))) for i in range(0, len(rows), 37)]
    got = [list(x) for x in repeats.pools(iter(batches), 9_000)]
    assert max(len(x) for x in got[:-1]) <= 30 and len(got[-1]) == 90 and min(map(len, got)) > 1
    names = [r[0] for r in rows]
    assert [r for x in got for r in x] == [r[1:] for r in rows if names.count(r[0]) > 1]
    assert list(repeats.pools(iter([]))) == []


def test_suffix_sort_memory():
    rng = np.random.default_rng(4)
    strings = [bytes(rng.integers(97, 123, 280).astype("u1")) for _ in range(900)]
    strings += strings[:100]
    tracemalloc.start()
    try:
        hits = suffixes.repeated(strings, 200)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [len(x) for x in hits] == [81] * 100 + [0] * 800 + [81] * 100
    assert most < 85 * sum(map(len, strings))


def test_packing_leaves_no_caches():
    tok = packing.UnitTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    first = list(tok.encode(x for x in ["some words, and more words"]))
    tok.forget()
    assert not tok.cache and not tok.words and list(tok.encode(["some words, and more words"])) == first
