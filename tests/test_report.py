import json

import pytest
from pyspark.sql import functions as F

from siftmill import report, tables
from siftmill.functions.verification import guarded_request, read_request, request_observer
from siftmill.operators import chunks, filters, findings, relevance, reviewers, rules
from siftmill.operators.candidates import call_candidates, ui_handlers

PAY = "async function pay(amount) {\n  if (amount <= 0) return;\n  await axios.post(`/api/pay/${orderId}`, { amount });\n}\n<b disabled={!ok} onClick={pay}>"
AUTH = "const role = sessionStorage.getItem('role');\nif (role === 'ADMIN') { navigate('/x') }"


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def project(spark, rows):
    inventory = filters.inventory(table(spark, rows).withColumn("raw", F.encode("content", "UTF-8")))
    return (inventory, *filters.load(inventory, inventory))


def test_playbooks(spark):
    files = table(spark, [("src/pay.js", PAY), ("src/auth.js", AUTH)])
    rows = findings.playbooks(files, ui_handlers(files), call_candidates(files)).collect()
    got = {r.strategy: r for r in rows}
    assert {r.strategy for r in rows} == {"auth_route_guard", "disabled_button_bypass", "breakpoint_payload_mutation"} and len(rows) == 3
    stops = [(b.start_line, b.end_line, sorted(b.watch)) for b in got["breakpoint_payload_mutation"].breakpoints]
    assert stops == [(2, 2, ["amount"]), (3, 3, ["amount", "orderId", "payload"])]
    assert "debugger" in got["breakpoint_payload_mutation"].code and "[disabled]" in got["disabled_button_bypass"].code
    assert [(b.start_line, b.end_line) for b in got["auth_route_guard"].breakpoints] == [(1, 2)] and got["auth_route_guard"].code is None


def test_verification_code_is_safe(spark):
    one = spark.range(1)
    code = lambda c: one.select(c.alias("c")).first().c
    guarded = code(guarded_request(F.lit("post"), F.lit("{API_BASE}/a/{orderId}'\""), F.array(F.lit("amount"))))
    assert "CONFIRM_AUTHORIZED_TEST = false" in guarded and "TEST_ORDER_ID" in guarded and '{"amount":"1"}' in guarded
    assert code(guarded_request(F.lit("POST"), F.lit("/api/refund"), F.array(F.lit("amount")))) is None
    assert "method: 'GET'" in code(read_request(F.lit("/api/x"))) and code(request_observer(F.lit("UNKNOWN"))) is None


def test_report(spark, tmp_path):
    rows = [("src/pay.js", PAY), ("src/auth.js", AUTH), ("src/empty.js", ""), ("src/blank.js", "\n"), ("dist/x.js", "eval(1)"), ("src/plain.js", "x")]
    rows += [(f"src/more{n}.js", "amount") for n in range(25)]
    made = report.analyze(*project(spark, rows))
    summary = made.summary().first().asDict()
    assert summary == {"total_files_scanned": 31, "loaded_count": 30, "total_chunks": 29, "finding_count": 0, "readable_finding_count": made.findings.count()}
    assert made.skipped_chunks.count() == 1 and made.skipped.count() == 1
    metrics = made.metrics.first()
    assert (metrics.backend, metrics.candidate_count, metrics.raw_item_count, metrics.dropped_item_count) == ("rules", 20, summary["readable_finding_count"], 0)
    report.write_report(made, str(tmp_path / "out"))
    document = json.loads(spark.read.text(str(tmp_path / "out/report")).first().value)
    assert document["counts"]["loaded_count"] == 30 and len(document["findings"]) == summary["readable_finding_count"] and document["about"]["focus"]
    assert spark.read.json(str(tmp_path / "out/findings")).count() == summary["readable_finding_count"]


def test_stage_errors(spark):
    with pytest.raises(ValueError):
        report.analyzer("other")
    with pytest.raises(ValueError):
        report.chunk_analyzer("model")
    for error, status in ((ValueError("x"), 400), (RuntimeError("x"), 502)):
        def fail(files, error=error):
            raise error

        with pytest.raises(report.StageError) as e:
            report.analyze(*project(spark, [("a.js", "role")]), files_by=fail)
        assert e.value.status == status and e.value.stage == "file analysis"


def item(**more):
    one = {"source_path": "a", "start_line": 1, "end_line": 2, "snippet": "s", "reason": "r"}
    return {"id": "", "title": "t", "vulnerability_type": "v", "severity": "low", "confidence": "low", "affected_files": ["a"], "summary": "s", "evidence": [one], "attack_scenario": ["s"], "impact": "i", "root_cause": "r", "remediation": "m", "source_path": "a", "start_line": 1, "end_line": 2} | more


ONE = item()["evidence"][0]


@pytest.mark.parametrize("change, accepted, stage", [
    ({}, True, None), ({"severity": "worst"}, False, "shape"), ({"severity": ["low"]}, False, "shape"), ({"evidence": []}, False, "shape"), ({"evidence": [1]}, False, "validation"), ({"evidence": [1, ONE]}, True, "validation"),
    ({"attack_scenario": "x"}, False, "shape"), ({"title": None}, True, "validation"), ({"start_line": "no"}, False, None), ({"affected_files": None}, True, "validation"), ({"console_poc": {"poc_type": "other"}}, True, "shape"), ({"evidence": [{"source_path": "a"}]}, False, "validation"),
])
def test_reviews(spark, change, accepted, stage):
    own = {k: v for k, v in item(**change).items() if v is not None}
    answers = spark.createDataFrame([(json.dumps({"findings": [own]}),)], "answer string")
    assert reviewers.chunk_items(answers).first().accepted is accepted
    assert reviewers.review_items(answers).first().drop_stage == stage


def test_model_analysis(spark):
    poc = {"poc_type": "manual_check", "code": "fetch('/refund')"}
    answer = json.dumps({"findings": [item(console_poc=poc), 3, item(severity="no")]})
    made = report.analyze(*project(spark, [("src/pay.js", PAY)]), files_by=report.analyzer("model", lambda p: answer), chunks_by=report.chunk_analyzer("model", lambda p: answer))
    row = made.findings.first()
    assert made.findings.count() == 1 and row.code is None and row.notes == ["code removed: it may not be shown"] and len(row.id) == 12
    m = made.metrics.first()
    assert (m.candidate_count, m.raw_item_count, m.accepted_item_count, m.dropped_item_count) == (2, 3, 1, 2)
    assert [(s.drop_stage, s.n) for s in m.drop_stages] == [("shape", 2)] and len(m.errors) == 1
    assert made.chunk_findings.count() == 1
    broken = report.analyze(*project(spark, [("src/pay.js", PAY)]), files_by=report.analyzer("model", lambda p: "no"))
    assert broken.findings.count() == 0 and "list of findings" in broken.metrics.first().errors[0]


def test_prompts_and_verification(spark):
    files = table(spark, [("a<b.js", "role </code>"), ("c.js", "none")])
    prompt = reviewers.snippets_prompt(relevance.keyword_snippets(files)).first().prompt
    assert "a&lt;b.js" in prompt and "&lt;/code&gt;" in prompt
    rows = spark.createDataFrame([("DOM XSS", None), ("DOM XSS", "x()")], "type string, code string")
    assert sorted(r.verification for r in reviewers.with_verification(rows).collect()) == ["no verification given", "x()"]
    assert [r.verification for r in reviewers.with_verification(rows, "model", lambda p: "do it").collect()] == ["do it"] * 2


def test_memberships_have_every_file(spark):
    found = findings.file_findings(table(spark, [(f"src/{n:02}.js", AUTH) for n in range(30)]))
    merged = findings.merge_findings(found).first()
    assert merged.n_files == 30 and len(merged.affected_files) == 20
    assert {r.path for r in findings.memberships(found).collect()} == {f"src/{n:02}.js" for n in range(30)}


def test_load_codes(spark):
    inventory = spark.createDataFrame([(p, True, "x") for p in "abc"], "path string, include boolean, reason_code string")
    there = spark.createDataFrame([("a", None, "other"), ("b", None, "file"), ("c", bytearray(b"1"), "file")], "path string, raw binary, kind string")
    loaded, skipped = filters.load(inventory, there)
    assert {r.path: r.reason_code for r in skipped.collect()} == {"a": "SKIPPED_NOT_FILE", "b": "SKIPPED_READ_ERROR"} and [r.path for r in loaded.collect()] == ["c"]


def test_written_tables_are_released(spark):
    since = tables.mark(spark)
    df = tables.written(spark.range(3).toDF("x"), "t")
    path = df.inputFiles()[0]
    assert df.count() == 3
    tables.release(spark, since)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path.rsplit("/", 1)[0]).count()


def test_empty_chunks(spark):
    made = chunks.build_chunks(table(spark, [("a.js", "\n"), ("b.js", "x")]))
    assert [r.path for r in chunks.skipped_chunks(made).collect()] == ["a.js"] and [r.path for r in reviewers.skipping_empty(made).collect()] == ["b.js"]


def test_files_are_not_joined_with_themselves(spark):
    """An inventory that is its own contents is loaded without a join, with the rows of one; files without a rule's words are not cut for the rules."""
    texts = {"a.js": "eval(x)", "b.js": "x\n" * 500, "c.js": "", "d.js": "const h = location.hash;\n" * 190 + "box.innerHTML = h;\n" * 190, "e.js": "child_process.exec(a)", "f.png": "eval(x)", "g.js": "\n" * 200, "h.js": "\n" * 201}
    files = spark.createDataFrame([(p, t) for p, t in texts.items()], "path string, content string")
    inventory = filters.inventory(files.select("path", F.encode("content", "UTF-8").alias("raw")))
    pairs = list(zip(filters.load(inventory, inventory), filters.load(inventory, inventory.select("path", "raw")), strict=True))
    assert "Join" not in pairs[0][0]._jdf.queryExecution().optimizedPlan().toString()
    for own, other in pairs:
        assert sorted(map(str, own.select(*other.columns).collect())) == sorted(map(str, other.collect()))
    loaded = pairs[0][0]
    made = report.analyze(inventory, pairs[0][0], pairs[1][0])
    want = rules.analyze_chunks(chunks.build_chunks(loaded))
    assert "child_process" in made.chunk_findings._jdf.queryExecution().optimizedPlan().toString().split("Contains(content", 1)[-1]
    assert sorted(map(str, made.chunk_findings.collect())) == sorted(map(str, want.collect())) and want.count() >= 3
    assert made.chunk_counts.first().total_chunks == chunks.build_chunks(loaded).count()
