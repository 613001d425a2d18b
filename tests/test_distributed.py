"""Operators that spread one large group, archive or document over tasks: running sums, archive ranges, blocks, siblings, ledger, document."""

import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siftmill import report, tables
from siftmill.config import EngineConfig
from siftmill.operators import blocks, filters, findings, relevance, reviewers, rules
from siftmill.operators.running import running_sum, running_sums
from siftmill.sources import zips
from siftmill.sources.archives import expand_archives, read_archives, settle
from siftmill.sources.corpus import code_files


def test_running_sum_of_one_hot_group(spark):
    """All rows in one group: the sums of a plain loop, and more than one task has rows."""
    rng = random.Random(1)
    rows = [("hot", k, rng.choice([None, 1, 5])) for k in range(5000)] + [(g, k, k) for g in ("a", None) for k in range(5)]
    rng.shuffle(rows)
    got = running_sum(spark.createDataFrame(rows, "g string, k int, v int"), ["g"], [F.col("k")], "v", "sum", parts=16).collect()
    want, sums = {}, {}
    for g, k, v in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        sums[g] = sums.get(g, 0) + (v or 0)
        want[g, k] = sums[g]
    assert {(r.g, r.k): r["sum"] for r in got} == want and len(got) == len(rows)
    ranges = spark.read.parquet([p for p in spark._siftmill_tables if "siftmill-ranges" in p][-1])
    assert ranges.where("g = 'hot'").select("_range").distinct().count() >= 8


def test_running_sums_without_groups(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("v"))
    got = {r.k: (r.a, r.b) for r in running_sums(df, [], [F.col("k")], {"a": "v", "b": F.lit(1)}, 7).collect()}
    assert got == {k: (sum(x % 3 for x in range(k + 1)), k + 1) for k in range(100)}
    assert running_sum(df.limit(0), [], [F.col("k")], "v", "a").count() == 0


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for k in range(1000):
            z.writestr(f"d/{k}.txt", os.urandom(300))
    df = zips.read_zip_entries(spark, str(tmp_path), split_bytes=20_000)
    assert df.rdd.getNumPartitions() > 10
    rows = df.withColumn("task", F.spark_partition_id())
    assert rows.count() == 1000 and rows.select("task").distinct().count() > 10 and rows.select("entry_ord").distinct().count() == 1000
    with zipfile.ZipFile(tmp_path / "big.zip") as z:
        want = {i.filename: z.read(i) for i in z.infolist()}
    files, rejected = settle(df)
    assert {r.path: bytes(r.raw) for r in files.collect()} == want and rejected.count() == 0


def test_limits_come_from_the_directory(spark, tmp_path):
    """Limits, odd names and broken archives, by ranges and whole, as the reader of whole archives has them."""
    def archive(name, entries):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for path, data in entries:
                z.writestr(path, data)

    archive("ok.zip", [("a/", ""), ("a/x", "1"), ("a/x", "2"), ("b\\c", "3"), ("empty", "")])
    archive("up.zip", [("x", "1"), ("../y", "2")])
    archive("root.zip", [("/etc/x", "1")])
    archive("drive.zip", [("C:\\x", "1")])
    archive("many.zip", [(str(k), "1") for k in range(7)])
    archive("large.zip", [("x", "1" * 5000)])
    archive("none.zip", [])
    (tmp_path / "text.zip").write_bytes(b"no archive at all")
    (tmp_path / "cut.zip").write_bytes((tmp_path / "many.zip").read_bytes()[:-30])
    (tmp_path / "other.txt").write_bytes(b"PK")
    config = EngineConfig(max_members=6, max_unpacked_bytes=4000, max_archive_bytes=1 << 20)
    base = lambda p: p.rsplit("/", 1)[1]
    results = []
    for found in (settle(zips.read_zip_entries(spark, str(tmp_path), config)), settle(zips.read_zip_entries(spark, f"file://{tmp_path}", config, split_bytes=1)), expand_archives(read_archives(spark, str(tmp_path), config), config)):
        results.append((sorted((base(r.archive), r.path, bytes(r.raw)) for r in found[0].collect()), {base(r.archive): r.error for r in found[1].collect()}))
    assert results[0] == results[1] == results[2]
    assert results[0][0] == [("ok.zip", "a/x", b"2"), ("ok.zip", "b/c", b"3"), ("ok.zip", "empty", b"")]
    assert results[0][1] == {"up.zip": "OUTSIDE_BASE", "root.zip": "ABSOLUTE_PATH", "drive.zip": "ABSOLUTE_PATH", "many.zip": "TOO_MANY_MEMBERS", "large.zip": "TOO_LARGE_UNPACKED", "text.zip": "NOT_A_ZIP", "cut.zip": "BAD_ZIP", "other.txt": "NOT_A_ZIP_NAME"}


def plain_block(lines, at):
    for s in range(at, max(-1, at - 121), -1):
        name = next((m for h in blocks.HEADERS if (m := __import__("re").search(h, lines[s]))), None)
        if not name:
            continue
        depth, opened = 0, False
        for e in range(s, min(len(lines) - 1, at + 120) + 1):
            depth += lines[e].count("{")
            opened |= "{" in lines[e]
            depth -= lines[e].count("}")
            if opened and depth <= 0 and e >= at:
                return name[1], s + 1, e + 1
    return None, None, None


def test_blocks_of_every_line(spark):
    """Nested, unclosed, closed above, over 120 lines away: each line of random files against a plain loop."""
    rng, rows = random.Random(4), []
    kinds = ["function f#(a) {", "async function g#() {", "const h# = async (x) => {", "const k# = (x) => {", "function late#()", "{", "}", "}}", "if (x) { y(); }", "x();"]
    for n in range(6):
        lines = [rng.choices(kinds, [2, 1, 1, 1, 1, 2, 7, 1, 3, 12])[0].replace("#", str(k)) for k in range(400)]
        rows.append((f"f{n}", "\n".join(lines)))
    rows += [("far", "\n".join(["function a() {", *["x();"] * 119, "y();", *["x();"] * 119, "}"])), ("farther", "\n".join(["function a() {", *["x();"] * 121, "}"])), ("none", "x();\n}"), ("empty", "")]
    files = spark.createDataFrame(rows, "path string, content string")
    calls = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "x")).select("path", (F.col("i") + 1).alias("line"))
    got = {(r.path, r.line): (r.name, r.start_line, r.end_line) for r in blocks.function_blocks(files, calls).collect()}
    assert got == {(p, k + 1): plain_block(c.split("\n"), k) for p, c in rows for k in range(len(c.split("\n")))}
    hints = {(r.path, r.line) for r in blocks.all_guards(spark.createDataFrame([("a", "x\nif (amount) return;\nthrow new Error(); return price")], "path string, content string")).collect()}
    assert hints == {("a", 2), ("a", 3)}


def plain_flow(lines, sinks, sources, any_case):
    for i, x in enumerate(lines):
        low = x.lower()
        if any(s in low for s in sinks) and not any(h in low for h in rules.HARMLESS) and not __import__("re").search(rules.STATIC, low):
            near = "\n".join(lines[max(0, i - 6) : i + 7])
            if any((s.lower() in near.lower()) if any_case else (s in near) for s in sources):
                return i + 1
    return None


def test_flows_of_random_files(spark):
    rng, rows = random.Random(9), []
    kinds = ["x.innerHTML = y;", "a.outerHTML = location.hash;", "b.innerHTML = 'static';", "const u = document.url;", "location.search", "event.data", "step();", "DOCUMENT.WRITE(z)"]
    for n in range(300):
        rows.append((str(n), "\n".join(rng.choices(kinds, [1, 0.2, 1, 1, 1, 1, 30, 1], k=rng.randint(1, 60)))))
    got = spark.createDataFrame(rows, "path string, content string").select("path", rules.has_dom_flow(F.col("content")).alias("has"), rules.dom_flow(F.col("content")).alias("flow")).collect()
    for r, (_, content) in zip(sorted(got, key=lambda r: int(r.path)), rows, strict=True):
        lines = content.split("\n")
        assert r.has == (plain_flow(lines, rules.SINKS, rules.SOURCES, False) is not None)
        first = plain_flow(lines, rules.FILE_SINKS, rules.SOURCES, True)
        assert (r.flow and (r.flow.start_line, r.flow.end_line)) == (first and (max(1, first - 6), min(len(lines), first + 6)))


def test_siblings_in_a_deep_tree(spark):
    """Folders as prefixes, deep and with odd characters; no file is repeated for the folders above it."""
    rng, rows = random.Random(2), []
    texts = ["role", "admin", "document.cookie", "x", "usertype admin", ""]
    for n in range(400):
        parts = [rng.choice(["a", "ab", "a b", "ü", "\U0010fffe", "z"]) for _ in range(rng.randint(0, 9))]
        rows.append(("/".join([*parts, f"f{n}.js"]), rng.choice(texts)))
    df = spark.createDataFrame(rows, "path string, content string")
    got = {r.path: r.evidence for r in relevance.storage_evidence(df, df).collect()}
    for path, content in rows:
        folder = path.rpartition("/")[0]
        every = [content, *(c for p, c in rows if folder and p.startswith(folder))]
        assert got[path] == all(any(w in c for c in every for w in words) for words in (("document.cookie",), ("role", "usertype"), ("admin",))), path
    points = spark.read.parquet([p for p in spark._siftmill_tables if "siftmill-ranges" in p][-1])
    assert points.where("kind = 1").count() <= len(rows)


def test_the_ledger_answers_what_was_asked(spark, tmp_path):
    """A worker dies in the middle: the next run asks only what no answer was kept for; a third run asks nothing."""
    calls, dies = tmp_path / "calls", tmp_path / "dies"
    dies.write_text("")
    prompts = spark.range(40).select(F.concat(F.lit("p"), (F.col("id") % 30).cast("string")).alias("prompt"), F.col("id").alias("n")).repartition(1)

    def model(p):
        if p == "p13" and dies.exists():
            os._exit(1)
        with calls.open("a") as f:
            f.write(p + "\n")
        if p == "p5":
            raise ValueError("secret")
        return p.upper()

    with pytest.raises(Exception):  # noqa: B017
        reviewers.ask_once(prompts, model, str(tmp_path / "ledger"), every=1)
    first = calls.read_text().split()
    dies.unlink()
    got = reviewers.ask_once(prompts, model, f"file://{tmp_path}/ledger", every=7).collect()
    assert sorted(r.n for r in got) == list(range(40))
    assert all((r.answer, r.error) == ((None, "ValueError") if r.prompt == "p5" else (r.prompt.upper(), None)) for r in got)
    every = calls.read_text().split()
    assert len(first) == len(set(first)) and sorted(set(every)) == sorted({f"p{k}" for k in range(30)})
    assert len(every) == 30 + every.count("p5") - 1  # failed calls alone are asked again
    reviewers.ask_once(prompts, model, str(tmp_path / "ledger")).collect()
    assert len(calls.read_text().split()) == len(every) + 1


def made_report(spark, n=30):
    rows = [("src/pay.js", "async function pay(amount) {\n  if (amount <= 0) return;\n  await axios.post(`/api/pay/${orderId}`, { amount });\n}"), ("src/q\"\\ü.js", "role\n\u2028x"), ("dist/x.js", "eval(1)")]
    rows += [(f"src/f{k}.js", f"eval({k})") for k in range(n)]
    inventory = filters.inventory(spark.createDataFrame(rows, "path string, content string").withColumn("raw", F.encode("content", "UTF-8")))
    return report.analyze(inventory, *filters.load(inventory, inventory))


def test_document_has_every_part(spark, tmp_path):
    made = made_report(spark)
    manifest = report.write_document(made, f"file://{tmp_path}/doc")
    text = b"".join(report.document(str(tmp_path / "doc"), block=100))
    assert len(text) == manifest["bytes"] and all(text[p["offset"] : p["offset"] + p["bytes"]].decode() for p in manifest["pieces"])
    held = json.loads(text)
    for name in report.PARTS:
        assert len(held[name]) == getattr(made, name).count(), name
    assert [r["path"] for r in held["inventory"]] == sorted(r["path"] for r in held["inventory"]) and len(held["inventory"]) == 33
    assert held["counts"]["total_files_scanned"] == 33 and held["metrics"]["backend"] == "rules" and held["about"]["focus"]
    assert {r["path"] for r in held["chunk_findings"]} == {f"src/f{k}.js" for k in range(30)}
    again = report.write_document(made_report(spark, 0), str(tmp_path / "doc2"))
    assert json.loads(b"".join(report.document(str(tmp_path / "doc2"))))["chunk_findings"] == [] and again["pieces"]


def test_findings_of_batches_are_those_of_all_files(spark, tmp_path):
    """Three batches, one of which is tried again, give the merged findings of all files at once."""
    auth = "const role = sessionStorage.getItem('role');\nif (role === 'ADMIN') { navigate('/x') }"
    rows = [(f"src/a{k:02}.js", auth) for k in range(24)] + [(f"src/p{k}.js", f"axios.post('/api/pay/{k % 3}', {{ amount }});\naxios.post('/api/pay/0', {{ amount }});") for k in range(9)]
    random.Random(7).shuffle(rows)
    table = lambda part: spark.createDataFrame(part, "path string, content string")
    found = findings.file_findings(table(rows))
    held = findings.FindingsOverTime(spark, f"file://{tmp_path}/findings")
    for number, paths in enumerate((rows[:5], rows[5:20], rows[5:20], rows[20:])):
        held.add(found.join(table(paths).select("path"), "path", "left_semi").select(*findings.COLUMNS), number - (number > 1))
    tell = lambda df: sorted(map(str, df.drop("at").collect()))
    assert tell(held.merged()) == tell(findings.merge_findings(found)) and held.merged().count() > 2
    assert len(held._numbers()) == 2


def test_metrics_come_from_the_runs_own_jobs(spark):
    """The row is made of numbers that the jobs of the run observed; reading it reads no table."""
    made = made_report(spark)
    plan = made.metrics._jdf.queryExecution().executedPlan().toString()
    row = made.metrics.first()
    assert row.candidate_count == 20 and row.raw_item_count == made.findings.count() and row.drop_stages == [] and row.errors == []
    assert not any(x in plan for x in ("FileScan", "Aggregate", "Exchange", "Join"))
    assert tables.metrics_of(made.findings) == {"rows": row.raw_item_count} and tables.metrics_of(spark.range(1)) == {}


def test_a_task_is_given_a_bounded_number_of_rows(spark, monkeypatch):
    """The parts of the derived corpus and of the merging follow the rows; a key that all files share is dealt out by file and comes out whole."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 100)
    files = code_files(spark, "/root/testdata/sf0.001")
    assert files.rdd.getNumPartitions() == -(-files.count() // 100)
    assert max(files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) < 200
    paths = sorted(f"p/{n}.js" for n in range(700))
    same = spark.createDataFrame([(p, "const h = location.hash;\nbox.innerHTML = h;") for p in paths], "path string, content string")
    merged = findings.merge_findings(findings.dom_findings(same).select(*findings.COLUMNS))
    assert merged.rdd.getNumPartitions() == 7
    row = merged.collect()
    assert [(r.n_files, r.merged, r.affected_files, [e.path for e in r.evidence]) for r in row] == [(700, 700, paths[:20], paths[:5])]
