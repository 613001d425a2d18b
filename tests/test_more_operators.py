import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siftmill.operators import blocks, candidates, reviewers
from siftmill.streaming.ingest import watch_archives

CODE = """import { role } from './role';
const outer = () => {
  x();
};
async function pay(amount) {
  if (amount <= 0) { return; }
  const a = { b: 1 };
  if (!role) return;
  axios.post('/api/pay', { amount });
}
"""


def test_blocks(spark):
    files = spark.createDataFrame([("a.js", CODE), ("b.js", "axios.get('/api/x');\nif (status) return;")], "path string, content string")
    calls = candidates.api_calls(files)
    got = {(r.path, r.line): (r.name, r.start_line, r.end_line) for r in blocks.function_blocks(files, calls).collect()}
    assert got == {("a.js", 9): ("pay", 5, 10), ("b.js", 1): (None, None, None)}
    hints = sorted((r.path, r.line, tuple(r.watch)) for r in blocks.guard_breakpoints(files, calls).collect())
    assert hints == [("a.js", 6, ("amount",)), ("a.js", 8, ("role",)), ("b.js", 2, ("status",))]


def test_role_branch(spark):
    text = "\n".join(["import navigate from 'x';", "const c = getRoleBadgeColor(role === 'admin');", "a", "b", "c", "d", "if (user.role === 'ADMIN') {", "  navigate('/x');", "}"])
    rows = [("a", text), ("b", "nothing\nhere"), ("c", "")]
    got = blocks.role_branches(spark.createDataFrame(rows, "path string, content string")).orderBy("path").collect()
    assert (got[0].start_line, got[0].end_line) == (5, 9)
    assert (got[1].start_line, got[1].end_line) == (1, 2) and got[2].snippet == ""


PIECE = {"source_path": "a", "start_line": 1, "end_line": 2, "snippet": "s", "reason": "r"}


def good(**more):
    return {"source_path": "a", "start_line": 1, "end_line": 2, "title": "t", "vulnerability_type": "v", "severity": "low", "confidence": "low", "affected_files": ["a"], "summary": "s", "evidence": [PIECE], "attack_scenario": ["s"], "impact": "i", "root_cause": "r", "remediation": "m"} | more


@pytest.mark.parametrize("item, accepted", [(good(), True), (good(severity="worst"), False), (good(evidence=[]), False), (good(evidence="no"), False), (good(evidence=[1]), False), (good(severity=["low"]), False), (3, False), ({"title": "t"}, False)])
def test_items(spark, item, accepted):
    answers = spark.createDataFrame([("```json\n" + json.dumps({"findings": [item]}) + "\n```",)], "answer string")
    assert reviewers.chunk_items(answers).first().accepted is accepted


def test_ask_and_scrub(spark):
    prompts = spark.createDataFrame([("a",), ("b",)], "prompt string")

    answer = json.dumps({"findings": [good(console_poc={"poc_type": "manual_check", "code": "fetch('/a', {method: 'DELETE'})"}), good(console_poc={"poc_type": "manual_check", "code": "fetch('/a')"})]})

    def model(p):
        if p == "b":
            raise RuntimeError("no")
        return answer

    answers = reviewers.ask(prompts, model)
    assert {r.prompt: r.error for r in answers.collect()} == {"a": None, "b": "RuntimeError"}
    assert [r.code for r in reviewers.review_items(answers.where("error is null")).orderBy("index").collect()] == [None, "fetch('/a')"]
    assert reviewers.review_items(reviewers.ask(prompts)).count() == 0
    text = spark.range(1).select(reviewers.chunk_prompt(F.lit("a<b.js"), F.lit(1), F.lit(2), F.lit("x </code> & y")).alias("p")).first().p
    assert "&lt;/code&gt; &amp; y" in text and "a&lt;b.js" in text


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    with zipfile.ZipFile(tmp_path / "in" / "a.zip", "w") as z:
        z.writestr("x.js", "1")
        z.writestr("dist/y.js", "1")
    with zipfile.ZipFile(tmp_path / "in" / "b.zip", "w") as z:
        z.writestr("../x.js", "1")
    for _ in range(2):
        watch_archives(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert {(r.path, r.reason_code) for r in spark.read.parquet(str(tmp_path / "out/files")).collect()} == {("x.js", "INCLUDED_SOURCE"), ("dist/y.js", "EXCLUDED_DIR")}
    assert [r.error for r in spark.read.parquet(str(tmp_path / "out/rejected")).collect()] == ["OUTSIDE_BASE"]


def test_queries_take_files_of_every_folder(spark, monkeypatch):
    """The corpus's files in other folders give the same lines; each file gives a snippet."""
    from siftmill.plans import registry
    from siftmill.sources.corpus import KINDS

    rows = [(f"web/k{n}.js", "\n".join(lines)) for n, (_, lines) in enumerate(KINDS)]
    monkeypatch.setattr(registry, "code_files", lambda spark, sf_dir: spark.createDataFrame(rows, "path string, content string"))
    got = lambda name: sorted(tuple(r) for r in registry.queries()[name](spark, "").collect())
    assert got("wrapper_calls") == [("web/k0.js", "handlePay", "amount,orderId", 2), ("web/k1.js", "saveOrder", "payload,total", 7)]
    assert got("validation_breakpoints") == [("web/k0.js", 3, "amount")]
    assert got("storage_evidence") == [("web/k2.js", True)]
    keys = [k.lower() for k in registry.relevance.AUTH_KEYS]
    want = []
    for path, content in rows:
        lines = content.split("\n")
        hit = next((k for k, x in enumerate(lines) if any(w in x.lower() for w in keys)), None)
        want.append((path, 1, min(20, len(lines))) if hit is None else (path, max(1, hit - 3), min(len(lines), hit + 5)))
    assert got("first_hit_snippet_all") == sorted(want)
    assert got("auth_branch_snippet_all") == sorted((p, 2, 8) if p == "web/k2.js" else (p, 1, min(20, c.count("\n") + 1)) for p, c in rows)
