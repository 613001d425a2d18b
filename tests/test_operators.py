import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siftmill.config import EngineConfig
from siftmill.functions import requests as R
from siftmill.functions.text import extension, matches, split_lines, strip
from siftmill.operators import candidates, chunks, filters, findings, relevance, rules
from siftmill.sources.archives import expand_archives, read_archives


def files(spark, **contents):
    return spark.createDataFrame(list(contents.items()) if contents else [], "path string, content string")


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_split_lines_is_pythons(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choice(["a", "b", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029", " "]) for _ in range(rng.randint(0, 12))),) for _ in range(800)]
    got = spark.createDataFrame(rows, "t string").select("t", split_lines(F.col("t")).alias("l")).collect()
    assert all(r.l == r.t.splitlines() for r in got)


def test_extension_and_matches(spark):
    rows = [(".env", ""), (".env.example", ".example"), ("a.", ""), ("..js", ".js"), ("x/a.tar.GZ", ".gz"), ("Dockerfile", "")]
    got = spark.createDataFrame(rows, "p string, e string").select(extension(F.col("p")).alias("x"), "e").collect()
    assert all(r.x == r.e for r in got)
    m = spark.createDataFrame([("aXbbX",)], "t string").select(matches(F.col("t"), "X").alias("m")).first().m
    assert [(x.start, x.hit) for x in m] == [(1, "X"), (4, "X")]


@pytest.mark.parametrize("lines, config, want", [(450, EngineConfig(), [(1, 200), (181, 380), (361, 450)]), (9, EngineConfig(chunk_lines=5, overlap_lines=2), [(1, 5), (4, 8), (7, 9)])])
def test_chunk_frames(spark, lines, config, want):
    got = chunks.build_chunks(table(spark, [("a.js", "\n".join(map(str, range(lines)))), ("b.js", "")]), config).orderBy("chunk_index").collect()
    assert [(r.start_line, r.end_line) for r in got] == want and {r.total_chunks for r in got} == {len(want)}


def test_chunk_config_is_checked():
    for a, b in ((5, 5), (0, 0), (5, -1)):
        with pytest.raises(ValueError):
            EngineConfig(chunk_lines=a, overlap_lines=b)


@pytest.mark.parametrize("path, code", [
    ("a/node_modules/index.js", "EXCLUDED_DIR"), ("src/.env", "EXCLUDED_EXTENSION"), ("src/.env.example", "INCLUDED_CONFIG"), ("lib/x.js", "EXCLUDED_THIRD_PARTY_LIBRARY"),
    ("js/jquery.custom-validation.js", "EXCLUDED_THIRD_PARTY_LIBRARY"), ("js/jquery.js", "INCLUDED_SOURCE"), ("js/a.min.js", "EXCLUDED_MINIFIED"), ("js/main.js", "INCLUDED_SOURCE"),
    ("js/app-0123abcd.js", "EXCLUDED_MINIFIED"), ("Dockerfile", "INCLUDED_CONFIG"), ("a.map", "EXCLUDED_MINIFIED"), ("v/a.JSP", "INCLUDED_TEMPLATE"), ("a.txt", "EXCLUDED_EXTENSION"), ("s/static/js/main.js", "EXCLUDED_MINIFIED"),
])
def test_filter_cascade(spark, path, code):
    df = spark.createDataFrame([(path, bytearray(b"x = 1"))], "path string, raw binary")
    assert filters.inventory(df).first().reason_code == code


def test_filter_reads_the_head(spark):
    df = spark.createDataFrame([("a.js", bytearray(b"ab\0c")), ("b.js", bytearray(b"x __webpack_require__")), ("c.js", bytearray(b"x" * 30))], "path string, raw binary")
    got = {r.path: r.reason_code for r in filters.inventory(df, EngineConfig(max_file_bytes=25)).collect()}
    assert got == {"a.js": "EXCLUDED_BINARY", "b.js": "EXCLUDED_MINIFIED", "c.js": "EXCLUDED_TOO_LARGE"}


def test_load_routes_rows(spark):
    inventory = spark.createDataFrame([("a.js", True, "x"), ("b.js", False, "x"), ("c.js", True, "x"), ("../d.js", True, "x"), ("e.js", True, "x")], "path string, include boolean, reason_code string")
    there = spark.createDataFrame([("a.js", bytearray(b"\xef\xbb\xbfhi")), ("b.js", bytearray(b"1")), ("e.js", bytearray(b"\xff\xfe"))], "path string, raw binary")
    loaded, skipped = filters.load(inventory, there)
    assert [r.path for r in loaded.collect()] == ["a.js"] and loaded.first().content == "\ufeffhi"
    assert {r.path: r.reason_code for r in skipped.collect()} == {"b.js": "SKIPPED_NOT_INCLUDED", "c.js": "SKIPPED_NOT_FOUND", "../d.js": "SKIPPED_PATH_TRAVERSAL", "e.js": "SKIPPED_DECODE_ERROR"}


def _zip(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, data, attr in entries:
            info = zipfile.ZipInfo(name)
            info.external_attr = attr
            z.writestr(info, data)


def test_archives(spark, tmp_path):
    _zip(tmp_path / "good.zip", [("foo\\bar.js", b"1", 0), ("d/", b"", 0), ("x.js", b"old", 0), ("x.js", b"new", 0)])
    _zip(tmp_path / "slip.zip", [("ok.js", b"1", 0), ("../x.js", b"1", 0)])
    _zip(tmp_path / "drive.zip", [("C:\\x.js", b"1", 0)])
    _zip(tmp_path / "link.zip", [("l", b"x", 0xA1FF << 16)])
    _zip(tmp_path / "many.zip", [(f"{n}.js", b"1", 0) for n in range(6)])
    _zip(tmp_path / "big.zip", [("a.js", b"x" * 500, 0)])
    (tmp_path / "text.zip").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_bytes(b"PK")
    entries, rejected = expand_archives(read_archives(spark, str(tmp_path)), EngineConfig(max_members=5, max_unpacked_bytes=400))
    name = F.element_at(F.split("archive", "/"), -1)
    assert {(r.n, r.path, bytes(r.raw)) for r in entries.select(name.alias("n"), "path", "raw").collect()} == {("good.zip", "foo/bar.js", b"1"), ("good.zip", "x.js", b"new")}
    assert {r.n: r.error for r in rejected.select(name.alias("n"), "error").collect()} == {"slip.zip": "OUTSIDE_BASE", "drive.zip": "ABSOLUTE_PATH", "link.zip": "SYMLINK", "many.zip": "TOO_MANY_MEMBERS", "big.zip": "TOO_LARGE_UNPACKED", "text.zip": "NOT_A_ZIP", "other.txt": "NOT_A_ZIP_NAME"}


def test_chunk_rules(spark):
    rows = [("a.js", "const h = location.hash;\nel.innerHTML = h;"), ("b.js", "el.innerHTML = 'x';\nlocation.hash"), ("c.js", "retrieval(x)"), ("d.js", "/x/.exec(y)"), ("e.js", "require('child_process').exec(a)"), ("f.js", "location.hash\n" + "\n" * 7 + "el.innerHTML = h"), ("lib/g.js", ""), ("a/lib/h.js", "location.hash; el.innerHTML = h")]
    got = {(r.path, r.type) for r in rules.analyze_chunks(chunks.build_chunks(table(spark, rows))).collect()}
    assert got == {("a.js", "DOM XSS"), ("c.js", "Unsafe eval"), ("e.js", "Command Injection")}


def calls(spark, text):
    return candidates.call_candidates(table(spark, [("a.js", text)])).orderBy("line", "pattern", "match").collect()


def test_calls(spark):
    one = calls(spark, "    const r = await apiClient.get(`${API_BASE}/verify-code`, { params: { limit: 10 } });")
    assert [(r.sink, r.method, r.endpoint, r.parameters) for r in one] == [("apiClient.get", "GET", "{API_BASE}/verify-code", ["limit"])]
    two = calls(spark, "axios.get('/api/a?x=1'); axios.post(base + '/v1/b', {\n  userId,\n  amount: 3\n});")
    assert [(r.method, r.endpoint, r.parameters, r.end_line) for r in two] == [("GET", "/api/a?x=1", ["x"], 1), ("POST", "/v1/b", [], 1)] or [(r.method, r.endpoint) for r in two] == [("GET", "/api/a?x=1"), ("POST", "/v1/b")]
    three = calls(spark, "apiClient.request({ method: 'PUT', url: '/api/status', data: form });")
    assert [(r.sink, r.method, r.endpoint) for r in three] == [("apiClient.request", "PUT", "/api/status"), ("request", "PUT", "/api/status")]
    four = calls(spark, "const { data: found } = await axios.post('/api/x', { found, id: 1 });")
    assert "found" not in four[0].parameters and "id" in four[0].parameters
    five = calls(spark, "x.saveOrder(a);\nsaveOrder(a, b);\ncalculateTotal(amount);\nif (amount) {}")
    assert [(r.line, r.sink, r.parameters) for r in five] == [(2, "function_call", ["a", "b"])]
    assert calls(spark, "") == []


def test_handlers(spark):
    got = candidates.ui_handlers(table(spark, [("a.jsx", "<b onClick={go} onChange={ch} disabled={!x}>\nfunction handleSubmitNow() {}")])).orderBy("line", "handler").collect()
    assert [(r.line, r.handler_name, r.ui_event, r.disabled_expression) for r in got] == [(1, "go", "onClick", None), (1, "ch", "onChange", None), (1, None, "disabled", "!x"), (2, "handleSubmitNow", "function_hint", None)]


@pytest.mark.parametrize("code, allowed", [
    ("fetch('/a', {method: 'POST'})", False), ("axios.delete('/a')", False), ("navigator.sendBeacon('/a')", False), ("fetch('/refund')", False), ("exec('x')", False), ("re.exec2(x)", True),
    ("/execute-query", True), ("const CONFIRM_AUTHORIZED_TEST = false; fetch('/a', {method: 'POST'})", False), ("const CONFIRM_AUTHORIZED_TEST = false; if (!CONFIRM_AUTHORIZED_TEST) return; fetch('/a', {method: 'POST'})", True),
])
def test_safety_filter(spark, code, allowed):
    assert spark.range(1).select(R.safe_to_show(F.lit(code)).alias("x")).first().x is allowed


def test_json_object(spark):
    rows = [('{"a": 1}', 1), ('```json\n{"a": 1}\n```', 1), ('so {"a": 1} it is', 1), ("[1]", None), ("no", None), ('{"a": ', None)]
    got = spark.createDataFrame(rows, "t string, w int").select("w", F.try_variant_get(R.json_object(F.col("t")), "$.a", "int").alias("g")).collect()
    assert all(r.w == r.g for r in got)


def test_relevance_and_snippets(spark):
    df = table(spark, [("src/login.js", "nothing"), ("a.js", "token"), ("b.js", "plain")])
    assert [(r.path, r.score) for r in relevance.most_relevant(df).collect()] == [("src/login.js", 2), ("a.js", 1)]
    asked = table(spark, [("a.js", "import { requireAuth } from '../sessionUtils'")])
    assert relevance.missing_dependencies(asked).count() == 1
    assert relevance.missing_dependencies(asked.union(table(spark, [("u/SessionUtils.js", "")]))).count() == 0
    got = relevance.keyword_snippets(table(spark, [("a.js", "x\n" * 30 + "role\n" + "y\n" * 30 + "role"), ("b.js", "z\n" * 30)])).orderBy("path", "start_line").collect()
    assert [(r.path, r.start_line, r.end_line, r.keyword) for r in got] == [("a.js", 25, 37, "role"), ("a.js", 56, 62, "role"), ("b.js", 1, 20, None)]


def test_storage_evidence_takes_folders_by_prefix(spark):
    df = table(spark, [("src/a/p.js", "role"), ("src/ab/q.js", "sessionStorage.getItem('x'); ADMIN"), ("src/b/r.js", "role")])
    got = {r.path: r.evidence for r in relevance.storage_evidence(df.where("content = 'role'"), df).collect()}
    assert got == {"src/a/p.js": True, "src/b/r.js": False}


def test_findings_merge(spark):
    auth = "if (role === 'ADMIN') { navigate('/x') }"
    df = table(spark, [("src/a.js", auth), ("src/b.js", auth), ("src/c.js", "axios.post('/api/a', { q: 1 }); \naxios.post('/api/b', { q: 1 });")])
    got = findings.merge_findings(findings.file_findings(df)).collect()
    kinds = sorted((r.type, r.n_files, r.merged) for r in got)
    assert kinds == [("Authorization Bypass", 2, 2), ("Client-side Validation Bypass", 1, 1), ("Client-side Validation Bypass", 1, 1)]
    assert len({r.id for r in got}) == 3


def test_severity(spark):
    rows = [("navigate('/')", "low"), ("navigate(); requireAuth()", "high"), ("navigate(); fetch(x)", "high"), ("x", "high")]
    assert all(r.w == r.s for r in spark.createDataFrame(rows, "c string, w string").select("w", R.auth_severity(F.col("c")).alias("s")).collect())


def test_calls_are_sought_by_words_first(spark):
    """Every call pattern's hits have one of its words, so that bytes are compared before any pattern runs; strip leaves plain ends alone."""
    hits = ["axios.get(", "apiClient.put(", "httpClient.post(", "client.patch(", "request.delete(", "fetch(", "$.ajax(", "jQuery.ajax(", "apiClient.request(", "request("]
    got = candidates.call_candidates(table(spark, [(f"{n}.js", f"{h}'/api/a')") for n, h in enumerate(hits)])).where("sink != 'function_call'")
    assert {r.path for r in got.select("path").collect()} == {f"{n}.js" for n in range(len(hits))}
    plan = candidates.api_calls(table(spark, [("a.js", "x")]))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(content" in plan and "URLSearchParams(" in plan
    texts_ = ["", " ", "a", " a", "a ", "é ", " é", "a b", "\ta b\n"]
    rows = spark.createDataFrame([(t,) for t in texts_], "t string").select("t", strip(F.col("t")).alias("s"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("want")).collect()
    assert all(r.s == r.want for r in rows) and len(rows) == len(texts_)
