"""Blocks and guards around calls against a plain version, and what of a file is shuffled for them."""

import re

import numpy as np

from siftmill.operators import blocks

SHAPES = ["x = 1;", "}", "{", "if (a) {", "} else {", "}}", "if (amount) return;", "setError(role); return", "  return;", "function f(a) {", "async function g(", "const h = (a) => {", "const k = 1; { }"]


def plain(text, at):
    """Name, start and end of the innermost function around the line ``at`` (from 0), and the guards (lines from 1) in it or near it."""
    lines = text.split("\n")
    depth, opened = [], []
    for x in lines:
        depth.append((depth[-1] if depth else 0) + x.count("{") - x.count("}"))
        opened.append((opened[-1] if opened else 0) + x.count("{"))
    found = None
    for i in range(max(0, at - 120), at + 1):
        name = next((m.group(1) for p in blocks.HEADERS if (m := re.search(p, lines[i]))), None)
        before, known = (depth[i - 1], opened[i - 1]) if i else (0, 0)
        end = next((k for k in range(at, min(len(lines), at + 121)) if depth[k] <= before and opened[k] > known), None)
        if name and end is not None:
            found = (name, i + 1, end + 1)
    a, b = found[1:] if found else (max(1, at + 1 - 80), at + 1 + 80)
    guards = [k + 1 for k, x in enumerate(lines) if a <= k + 1 <= b and x in ("if (amount) return;", "setError(role); return")]
    return found, guards


def test_blocks_and_guards_are_the_plain_ones(spark):
    rng = np.random.default_rng(4)
    files, calls = [], []
    for n in range(60):
        lines = [SHAPES[0] if rng.random() < n / 80 else SHAPES[k] for k in rng.integers(0, len(SHAPES), int(rng.integers(1, 400)))]
        files.append((f"f{n}", "\n".join(lines)))
        calls += [(f"f{n}", int(k)) for k in rng.integers(1, len(lines) + 1, 12)]
    texts, asked = dict(files), sorted(set(calls))
    f, c = spark.createDataFrame(files, "path string, content string"), spark.createDataFrame(calls, "path string, line int")
    got = {(r.path, r.line): (r.name and (r.name, r.start_line, r.end_line)) for r in blocks.function_blocks(f, c).collect()}
    assert got == {(p, k): plain(texts[p], k - 1)[0] for p, k in asked}
    assert sum(v is not None for v in got.values()) > 100
    guards = sorted((r.path, r.call_line, r.line) for r in blocks.guard_breakpoints(f, c).collect())
    assert guards == sorted((p, k, g) for p, k in asked for g in plain(texts[p], k - 1)[1])


def test_lines_are_shuffled_once_and_no_texts(spark):
    """One exchange, by file; neither texts nor arrays of lines pass it."""
    f = spark.createDataFrame([("a", "function f() {\n}")], "path string, content string")
    c = spark.createDataFrame([("a", 1)], "path string, line int")
    plan = blocks.guard_breakpoints(f, c)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(path") == plan.count("Exchange hash") == 1 and "BroadcastExchange" not in plan


def test_branches_without_a_second_read(spark, tmp_path):
    """The branch's line comes with its row: the files are not joined with themselves."""
    from siftmill.plans import registry

    plan = registry.queries()["role_branch_varied"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_a_name_is_tried_once(spark):
    """Long names without a call: each is read once, not again from each of its letters."""
    import time

    from siftmill.operators import candidates

    files = spark.createDataFrame([("a", "x" * 100_000), ("b", "1payOrder(a, b)\n9_9save1(data)\nx.pay(data)\nrequest(payData(1))")], "path string, content string")
    began = time.monotonic()
    got = sorted((r.path, r.line, r.snippet) for r in candidates.wrapper_calls(files).collect())
    assert got == [("b", 1, "1payOrder(a, b)"), ("b", 2, "9_9save1(data)")]
    assert time.monotonic() - began < 15
