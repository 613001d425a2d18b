"""Findings read their files once, and what they leave out changes nothing."""

import re

from pyspark.sql import functions as F

from siftmill.functions import text
from siftmill.operators import findings
from siftmill.operators.candidates import ui_handlers
from siftmill.sources.corpus import KINDS

PAY = "<button disabled={!ready} onClick={pay}>x</button>"
ODD = [
    ("a/only.js", f"updateOrder(payload);\n{PAY}"),  # a control and no call that passes the coarse test
    ("a/both.js", f"saveOrder(data);\r\naxios.post('/api/a', {{ amount }});\x0b{PAY}"),
    ("a/none.js", "updateOrder(payload);"),
    ("a/lib/x.js", f"axios.post('/api/b', {{ amount }});\n{PAY}"),  # third-party code
    ("a/app-abcdef12.js", f"axios.post('/api/b', {{ amount }});\n{PAY}"),
    ("a/late.js", "x" * 9000 + f"webpackChunk\naxios.post('/api/c', {{ price }});\n{PAY}"),  # the sign of a build stands too late
    ("a/role.js", "if (user.role === 'admin') navigate('/x');"),
    ("a/store/deep.js", "localStorage.getItem('role')"),
    ("b/asks.js", "import { checkSession } from '../utils/sessionUtils';"),
    ("b/flow.js", "const h = location.hash;\nbox.innerHTML = h;\nfetch('/api/me/\U0001f600'); fetch('/api/order/1', { method: 'PUT', body: { status } });"),
    ("b/empty.js", ""),
    ("b/null.js", None),
]


def odd_files(spark):
    rows = ODD + [(p.replace("#", str(n)), "\n".join(x.replace("#", str(n)) for x in lines)) for p, lines in KINDS for n in (1, 2)]
    return spark.createDataFrame(rows, "path string, content string")


def test_the_files_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def tell(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    files = odd_files(spark).repartition(3)
    n = files.count()
    assert findings.file_findings(files.mapInArrow(tell, files.schema)).count() > 10
    assert read.value == n  # twelve times as many before


def test_findings_are_those_of_the_rules_one_by_one(spark):
    files = odd_files(spark)
    tell = lambda df: sorted(map(repr, df.select(*findings.COLUMNS).collect()))
    got = tell(findings.file_findings(files))
    assert got == tell(findings.findings_of(files, ui_handlers(files), findings.gated_calls(files))) and len(got) > 20


def test_lines_words_and_places(spark):
    ends = ["\n", "\r", "\r\n", "\n\r", "\x0b", "\f", "\x1c", "\x85", " ", "\n\n", ""]
    texts_ = [f"a{x}b{y}" for x in ends for y in ends]
    df = spark.createDataFrame([(t,) for t in texts_], "t string")
    assert [r[0] for r in df.select(text.split_lines(F.col("t"))).collect()] == [t.splitlines() for t in texts_]
    words = ("$.ajax", "^x", "a-b", "[y]", "\\d", "관리", "&&")
    samples = ["", "$.aja", "q$.ajax", "^x", "ab", "xa-b", "[y", "z[y]", "\\d", "1", "의 관리자", "&", "&&"]
    df = spark.createDataFrame([(t,) for t in samples], "t string")
    assert [r[0] for r in df.select(text.any_of(F.col("t"), words)).collect()] == [any(w in t for w in words) for t in samples]
    samples = ["request(", "xrequest( request(", "\U0001f600 request(", "request(request(", "\U0001f600request( é request("]
    df = spark.createDataFrame([(t,) for t in samples], "t string")
    got = [[(m.start, m.hit) for m in r[0]] for r in df.select(text.matches(F.col("t"), r"\b(request)()\(")).collect()]
    assert got == [[(m.start(), m.group()) for m in re.finditer(r"\b(request)()\(", t, re.ASCII)] for t in samples]


def test_what_is_left_out_changes_nothing_else(spark):
    found = findings.file_findings(odd_files(spark)).persist()
    whole, less = findings.merge_findings(found), findings.merge_findings(found, without=("notes", "code", "snippet", "data_flow"))
    assert set(whole.columns) - set(less.columns) == {"notes", "code"} and less.schema["evidence"].dataType.elementType.names == ["path", "start_line", "end_line", "reason"]
    same = [c for c in less.columns if c != "evidence"] + ["evidence.path", "evidence.start_line", "evidence.end_line", "evidence.reason"]
    tell = lambda df: sorted(map(repr, df.select(*same).collect()))
    assert tell(less) == tell(whole) and less.count() > 10
    found.unpersist()


def test_blocks_of_calls_end_where_their_parentheses_do(spark):
    from siftmill.operators.candidates import call_block

    blocks = [["f("], ["f(", "a", ")", "g(", ")"], ["f((", ")", ")", "x"], ["a", "f()", "b"], ["f(a", "b"] + ["c"] * 50, ["f(x)"], [")", "f("], ["a"]]
    df = spark.createDataFrame([(b,) for b in blocks], "b array<string>")
    assert [r[0] for r in df.select(call_block(F.col("b"))).collect()] == [1, 3, 3, 2, 52, 1, 2, 1]
