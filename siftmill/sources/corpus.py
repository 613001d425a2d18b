"""A corpus of source files derived from the table orders, by one SQL text that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.tables import parts_for

#: Path and lines of each kind of file; # stands for the order's key and ~ for its status in lower case.
KINDS = [
    ("src/pay/f#.js", ["import axios from 'axios';", "async function handlePay(amount, orderId) {", "  if (amount <= 0) return;", "  const payResult = await axios.post(`/api/orders/${orderId}/payment/~`, { amount, orderId, usePoints: 0 });", "  return payResult;", "}", "<button disabled={!ready || amount < 1} onClick={handlePay}>Pay</button>"]),
    ("src/pay/g#.js", ["const payload = { productId: 1, price: 2, memo: 3 };", "fetch('/api/cart/#/items', {", "  method: 'POST',", "  headers: { accept: 'json' },", "  body: JSON.stringify({ productId: 1, quantity: 2 }),", "});", "saveOrder(payload, total);"]),
    ("src/auth/f#.js", ["import { checkSession } from '../utils/sessionUtils';", "const role = sessionStorage.getItem('role');", "export function guard(navigate) {", "  requireAuth();", "  if (role === 'ADMIN') {", "    navigate('/admin/#');", "  }", "}"]),
    ("lib/f#.js", ["function run(code) {", "  return eval(code + '#');", "}"]),
    ("node_modules/x/f#.js", ["document.getElementById('a').innerHTML = 'static #';"]),
    ("public/f#.html", ["<script>", "const h = location.hash;", "const el = document.getElementById('o');", "el.innerHTML = h + '#';", "</script>"]),
    ("src/view/f#.min.js", ["a.innerHTML = 'x#';"]),
    ("src/view/f#.json", ['{"k": #}']),
    ("src/user/f#.js", ["    const list = await apiClient.get(`${API_BASE}/users/${userId}/orders?limit=10`);", "    apiClient.request({", "      method: 'PUT',", "      url: '/v1/users/#/status',", "      data: payload", "    });", "    request({ url: base + '/api/me' });", "  const { data: found } = await axios.get('/api/profile/#', { params: { page: 1 } });"]),
    ("server/run#.js", ["const cp = require('child_process').exec;", "child_process.exec('ls ' + dir);", "$.ajax({", "  url: '/api/reset/#',", '  type: "POST",', "  data: form", "});", "form.append('code', value);"]),
    ("assets/app-abcdef12#.js", ["self.webpackChunk = [];", "//# sourceMappingURL=app.js.map"]),
    ("src/deep/f#.js", [*(f"// note {n}" for n in range(30)), "window.name = location.search;", *(f"let v{n} = {n};" for n in range(8)), "box.outerHTML = view;", "axios.delete(base + '/api/items/#');"]),
]


def _literal(text: str, key: str, status: str) -> str:
    """A SQL expression for a line; the characters dollar and brace never stand together in one literal."""
    parts, at = [], ""
    for c in text:
        if c in "#~":
            parts += [f"'{at}'", key if c == "#" else status]
            at = ""
        elif c == "{" and at.endswith("$"):
            parts.append(f"'{at}'")
            at = c
        else:
            at += "''" if c == "'" else c
    parts.append(f"'{at}'")
    return f"concat({', '.join(parts)})" if len(parts) > 1 else parts[0]


def corpus_columns() -> list[str]:
    key, status = "cast(o_orderkey as varchar(20))", "lower(o_orderstatus)"
    which = f"case o_orderkey % {len(KINDS)}"
    path = " ".join(f"when {n} then {_literal(p, key, status)}" for n, (p, _) in enumerate(KINDS))
    body = " ".join(f"when {n} then concat_ws(chr(10), {', '.join(_literal(x, key, status) for x in lines)})" for n, (_, lines) in enumerate(KINDS))
    return [f"{which} {path} end as path", f"{which} {body} end as content"]


def _dealt(orders: DataFrame) -> DataFrame:
    """The rows of the table in parts of bounded size, however few files it has; its rows are counted from the files' footers.

    A key is exploded from an array of itself, as a filter of the texts made from it would otherwise run before it is dealt out."""
    parts = parts_for(orders.sparkSession, orders.count())
    rest = [c for c in orders.columns if c != "o_orderkey"]
    return orders.repartition(parts, "o_orderkey").select(F.explode(F.array("o_orderkey")).alias("o_orderkey"), *rest)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and content of every derived file."""
    return _dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus")).selectExpr(*corpus_columns())


CODE_FILES_SQL = f"select {', '.join(corpus_columns())} from orders"


# A second corpus, of which places and distances vary with the key: filler lines before, between and after what is looked for.
_FILL = {"before": 9, "between": 12, "after": 8}


def _fill(what: str, text: str) -> str:
    return f"repeat(concat('{text}', chr(10)), cast(o_orderkey % {_FILL[what]} as int))"


def _text(*parts: str) -> str:
    """Lines in quotes and filler texts, put together; filler brings its own line ends."""
    return f"concat({', '.join(p if p.startswith('repeat(') else f"'{p}', chr(10)" for p in parts)}, '// end')"


VARIED = {
    # a function around a guard and a call; of every seventh the brace is never closed
    "call": _text(_fill("before", "// note"), "async function act(amount) {", _fill("between", "  step();"), "  if (amount <= 0) return;", "  await axios.post(`/api/act`, { amount });", _fill("after", "  step();")) .replace("'// end')", "case when o_orderkey % 7 = 0 then '// end' else '}' end)"),
    # a source and, some lines on, a sink
    "flow": _text(_fill("before", "// note"), "const h = location.hash;", _fill("between", "step();"), "box.outerHTML = h;", _fill("after", "step();")),
    # an object that a call hands over by name, and a form that a value is appended to, at growing distances above the call
    "payload": _text(_fill("before", "// note"), "const body = { alpha: 1, beta: 2 };", *[_fill("between", "step();")] * 3, _fill("after", "step();"), "form.append(\"code\", v);", _fill("between", "step();"), "axios.post(\"/api/x\", { data: body });"),
    # a branch on a role between lines that only show one
    "role": _text("import { navigate } from app;", _fill("before", "// note"), "const c = badge(color);", _fill("between", "step();"), "if (user.role === admin) {", "  leave();", "}", _fill("after", "step();")),
}


# Kinds of files that the filter tells apart by name, size or bytes: a path (# is the key) and, as SQL, the content.
NAMED = [
    ("big/f#.js", "repeat('x', cast(9900 + o_orderkey % 200 as int))"), ("bin/f#.js", "concat(repeat('a', cast(o_orderkey * 37 % 8192 as int)), chr(1), 'a')"), ("web/static/js/main.js", "'x'"), ("doc/a#.license.txt", "'x'"), ("m/a#.map", "'x'"), ("c#/.env.example", "'x'"),
    ("c#/.env.sample", "'x'"), ("c#/prod.env", "'x'"), ("c#/package.json", "'x'"), ("c#/Dockerfile", "'x'"), ("c#/docker-compose.yaml", "'x'"), ("c#/vite.config.js", "'x'"), ("c#/Next.Config.js", "'x'"), ("c#/static/js/a.js.txt", "'x'"), ("c#/a.vue", "'x'"), ("c#/a.aspx", "'x'"), ("c#/README", "'x'"),
]


def named_columns() -> list[str]:
    """path and content of a file of each kind by the key; both engines read these."""
    which, key = f"case o_orderkey % {len(NAMED)}", "cast(o_orderkey as varchar(20))"
    path = " ".join(f"when {n} then {_literal(p, key, '')}" for n, (p, _) in enumerate(NAMED))
    body = " ".join(f"when {n} then {c}" for n, (_, c) in enumerate(NAMED))
    return [f"{which} {path} end as path", f"{which} {body} end as content"]


def varied_columns(kind: str) -> list[str]:
    return [f"concat('{kind}/f', cast(o_orderkey as varchar(20)), '.js') as path", f"{VARIED[kind]} as content"]


def varied_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """path and content of the files of one kind."""
    return _dealt(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")).selectExpr(*varied_columns(kind))
