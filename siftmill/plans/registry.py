"""The engine's queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.config import EngineConfig
from siftmill.functions import requests as R
from siftmill.functions.text import escape_html, extension, split_lines
from siftmill.operators import blocks, candidates, chunks, filters, findings, relevance, reviewers, rules
from siftmill.operators.running import running_sum
from siftmill.sources.archives import escapes_base, settle
from siftmill.report import analyze, write_document
from siftmill.sources.corpus import CODE_FILES_SQL, NAMED, code_files, corpus_columns, named_columns, varied_columns, varied_files
from siftmill.sources.zips import read_zip_entries, write_archives
from siftmill.tables import new_folder, parts_for, written

FLAGSHIP = "scan_decisions"
SMALL = EngineConfig(chunk_lines=20, overlap_lines=5)
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
CORPUS = f"with code_files as ({CODE_FILES_SQL})"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.inventory(code_files(spark, sf_dir).withColumn("raw", F.encode("content", "UTF-8")))


# The filter's cascade as it falls out for the derived corpus; names and folders stand in it as plain text.
_DECISION = """case
  when regexp_matches(lower(path), '(^|/)(node_modules|vendor|dist|build|coverage|\\.git|__pycache__|libs|cdn)(/|$)') then 'EXCLUDED_DIR'
  when regexp_matches(lower(name), '\\.min\\.js|\\.bundle\\.js|\\.chunk\\.js|bundle\\.js') then 'EXCLUDED_MINIFIED'
  when name like '%.js' and (regexp_matches(name, '^(jquery\\.[^.]+|jquery-ui|(bootstrap|lodash|underscore|moment|slick|swiper|chart|d3))\\.js$') or regexp_matches('/' || lower(path), '/(vendors?|node_modules|libs?|plugins)/')) then 'EXCLUDED_THIRD_PARTY_LIBRARY'
  when name like '%.js' and (regexp_matches(name, '^(app|commons|framework|runtime|polyfills?|vendors?)-[a-f0-9]{8,}\\.js$|^.+-[a-f0-9]{12,}\\.js$') or regexp_matches(left(content, 8192), 'webpackChunk|webpackJsonp|__webpack_require__|sourceMappingURL=')) then 'EXCLUDED_MINIFIED'
  when name like '%.json' then 'INCLUDED_CONFIG'
  when regexp_matches(name, '\\.(js|ts|jsx|tsx|vue|mjs|cjs)$') then 'INCLUDED_SOURCE'
  when regexp_matches(name, '\\.(html?|ejs|hbs|pug|jsp|do|php|aspx?)$') then 'INCLUDED_TEMPLATE'
  else 'EXCLUDED_EXTENSION' end"""
_DECIDED = f"{CORPUS}, named as (select *, regexp_extract(path, '[^/]+$') as name from code_files), decided as (select path, content, {_DECISION} as reason_code from named)"


@query(f"{_DECIDED} select reason_code, count(*) as files, cast(sum(strlen(content)) as bigint) as bytes from decided group by 1")
def scan_decisions(spark, sf_dir):
    return _inventory(spark, sf_dir).groupBy("reason_code").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


@query(f"{_DECIDED} select count(*) as total_files_scanned, count(*) filter (where reason_code like 'INCLUDED%') as included_count, count(*) filter (where reason_code like 'EXCLUDED%') as excluded_count from decided")
def scan_counts(spark, sf_dir):
    return filters.inventory_counts(_inventory(spark, sf_dir))


@query(f"{CORPUS} select coalesce(nullif(lower(regexp_extract(path, '[^/](\\.[^./]+)$', 1)), ''), '') as extension, count(*) as files from code_files group by 1")
def ext_distribution(spark, sf_dir):
    return code_files(spark, sf_dir).groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"))


@query(f"""with f as (select o_orderkey % {len(NAMED)} as kind, o_orderkey as k, {', '.join(named_columns())} from orders) select path, strlen(content) as size,
  case when strlen(content) > 10000 then 'EXCLUDED_TOO_LARGE' when kind = 1 and instr(content, chr(1)) <= 4096 then 'EXCLUDED_BINARY' when kind in (0, 1, 14) then 'INCLUDED_SOURCE' when kind in (2, 3, 4, 13) then 'EXCLUDED_MINIFIED'
  when kind in (7, 16) then 'EXCLUDED_EXTENSION' when kind = 15 then 'INCLUDED_TEMPLATE' else 'INCLUDED_CONFIG' end as reason_code from f""")
def scan_decisions_named(spark, sf_dir):
    """Size, bytes and names that the filter tells apart; the mark of a binary file stands for a zero byte, which no SQL text can hold."""
    files = table(spark, sf_dir, "orders").selectExpr(*named_columns()).withColumn("raw", F.encode(F.replace("content", F.lit("\x01"), F.lit("\x00")), "UTF-8"))
    return filters.inventory(files, EngineConfig(max_file_bytes=10000)).select("path", "size", "reason_code")


@query("select doc_id, sha256(text) as content_hash, strlen(text) as size from documents where text is not null")
def load_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("raw"))
    loaded, _ = filters.load(docs.withColumn("include", F.lit(True)).withColumn("reason_code", F.lit("INCLUDED_SOURCE")), docs)
    return loaded.select("doc_id", "content_hash", F.octet_length("content").cast("long").alias("size"))


@query(f"{_DECIDED}, marked as (select *, cast(split_part(regexp_replace(path, '[^0-9/]', '', 'g'), '/', -1) as varchar) as digits from decided) select case when reason_code like 'EXCLUDED%' then 'SKIPPED_NOT_INCLUDED' when length(path) % 5 = 0 then 'SKIPPED_NOT_FOUND' else 'LOADED' end as code, count(*) as files from marked group by 1")
def load_skip_codes(spark, sf_dir):
    inventory = _inventory(spark, sf_dir)
    there = inventory.where(F.length("path") % 5 != 0)
    loaded, skipped = filters.load(inventory, there)
    return loaded.select(F.lit("LOADED").alias("code")).union(skipped.select("reason_code")).groupBy("code").agg(F.count("*").alias("files"))


@query("select source, count(*) as members, cast(sum(strlen(text)) as bigint) as bytes, count(*) filter (where running > 200000) as over_cap from (select source, text, sum(strlen(text)) over (partition by source order by doc_id) as running from documents) group by source")
def archive_limits(spark, sf_dir):
    light = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").alias("bytes"))
    docs = running_sum(light, ["source"], [F.col("doc_id")], "bytes", "running")
    return docs.groupBy("source").agg(F.count("*").alias("members"), F.sum("bytes").cast("long").alias("bytes"), F.count_if(F.col("running") > 200000).alias("over_cap"))


def _archived(spark, sf_dir):
    """Archives of 50 documents each, written and read back; every fifth has an entry that leaves its folder, and every fifth one entry too many."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("raw"))
    number = F.floor(F.col("doc_id") / 50)
    kind, archive = F.pmod(number, F.lit(5)), F.concat(F.lit("a"), number.cast("string"), F.lit(".zip"))
    entries = docs.select("doc_id", archive.alias("archive"), kind.alias("kind"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "raw")
    more = entries.where("kind >= 3").groupBy("archive", "kind").agg(F.count("*").alias("n"))
    up = more.where("kind = 3").select("archive", F.lit("d/../../up.txt").alias("path"), F.lit(b"").alias("raw"))
    many = more.where("kind = 4").select("archive", F.explode(F.sequence(F.lit(1).cast("long"), 52 - F.col("n"))).alias("k")).select("archive", F.concat(F.lit("e/"), F.col("k").cast("string")).alias("path"), F.lit(b"").alias("raw"))
    folder = new_folder(spark, "archives")
    write_archives(entries.select("archive", "path", "raw").union(up).union(many), folder)
    return settle(read_zip_entries(spark, folder, EngineConfig(max_members=51)))


_ARCHIVED = "with e as (select doc_id // 50 as archive, (doc_id // 50) % 5 as kind, doc_id, coalesce(text, '') as text from documents where doc_id is not null)"


@query(f"{_ARCHIVED} select archive, 'd/' || doc_id || '.txt' as path, cast(strlen(text) as bigint) as size, sha256(text) as content_hash from e where kind < 3")
def archive_entries(spark, sf_dir):
    """Entries of archives that break no rule, by the data source that plans ranges of their directories."""
    files, _ = _archived(spark, sf_dir)
    return files.select(F.regexp_extract("archive", "a([0-9]+)[.]zip$", 1).cast("long").alias("archive"), "path", "size", F.sha2("raw", 256).alias("content_hash"))


@query(f"{_ARCHIVED} select distinct archive, case kind when 3 then 'OUTSIDE_BASE' else 'TOO_MANY_MEMBERS' end as error from e where kind >= 3")
def archive_rejects(spark, sf_dir):
    _, rejected = _archived(spark, sf_dir)
    return rejected.select(F.regexp_extract("archive", "a([0-9]+)[.]zip$", 1).cast("long").alias("archive"), "error")


@query("select o_orderkey % 4 as kind, count(*) as paths, case o_orderkey % 4 when 1 then true when 3 then true else false end as outside from orders group by 1, 3")
def path_containment(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 4
    path = F.when(kind == 0, "a/b/../c.js").when(kind == 1, "../x.js").when(kind == 2, "./a/./b.js").otherwise("a/../../b.js")
    return orders.groupBy(kind.alias("kind"), escapes_base(path).alias("outside")).agg(F.count("*").alias("paths")).select("kind", "paths", "outside")


_LINES = "case when text like '%' || chr(10) then list_slice(string_split(text, chr(10)), 1, -2) else string_split(text, chr(10)) end"


@query(f"select doc_id, cast(len({_LINES}) as bigint) as lines, sha256(list_aggregate({_LINES}, 'string_agg', '|')) as hash from documents where text <> ''")
def line_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", split_lines(F.col("text")).alias("l"))
    return docs.select("doc_id", long(F.size("l")).alias("lines"), F.sha2(F.array_join("l", "|"), 256).alias("hash"))


def _doc_files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


_FRAMES = f"lined as (select doc_id, {_LINES} as l from documents where text <> ''), spec as (select doc_id, l, unnest(range(0, cast(greatest(0, ceil((len(l) - 20) / 15.0)) as bigint) + 1)) as k from lined), frames as (select doc_id, k as chunk_index, 1 + 15 * k as start_line, least(15 * k + 20, len(l)) as end_line, list_aggregate(list_slice(l, 1 + 15 * k, least(15 * k + 20, len(l))), 'string_agg', chr(10)) as content from spec)"


@query(f"with {_FRAMES} select doc_id, chunk_index, start_line, end_line from frames")
def chunk_specs(spark, sf_dir):
    return chunks.build_chunks(_doc_files(spark, sf_dir), SMALL, ("doc_id",)).select("doc_id", long("chunk_index").alias("chunk_index"), long("start_line").alias("start_line"), long("end_line").alias("end_line"))


@query(f"with {_FRAMES} select doc_id, chunk_index, sha256(content) as chunk_hash from frames")
def chunk_hashes(spark, sf_dir):
    return chunks.build_chunks(_doc_files(spark, sf_dir), SMALL, ("doc_id",)).select("doc_id", long("chunk_index").alias("chunk_index"), "chunk_hash")


@query(f"with {_FRAMES} select (select count(*) from documents) as total_files, count(*) as total_chunks, count(distinct doc_id) as files_chunked, (select count(*) from documents) - count(distinct doc_id) as files_skipped from frames")
def chunk_counts(spark, sf_dir):
    return chunks.chunk_counts(_doc_files(spark, sf_dir), SMALL)


@query(f"with {_FRAMES} select doc_id, count(*) as total_chunks, max(end_line) as lines from frames group by 1")
def chunk_summary(spark, sf_dir):
    return chunks.build_chunks(_doc_files(spark, sf_dir), SMALL, ("doc_id",)).drop("content").groupBy("doc_id").agg(F.count("*").alias("total_chunks"), long(F.max("end_line")).alias("lines"))


@query("select 'public/f' || o_orderkey || '.html' as path, 1::bigint as start_line, 5::bigint as end_line from orders where o_orderkey % 12 = 5")
def context_window_hits(spark, sf_dir):
    files = code_files(spark, sf_dir).withColumn("f", rules.dom_flow(F.col("content"))).where("f is not null")
    return files.select("path", long("f.start_line").alias("start_line"), long("f.end_line").alias("end_line"))


def _rule(spark, sf_dir, kind):
    found = rules.analyze_chunks(chunks.build_chunks(code_files(spark, sf_dir)))
    return found.where(F.col("type") == kind).select("path", "severity", "confidence", long("start_line").alias("start_line"), long("end_line").alias("end_line"))


@query(f"{CORPUS} select path, 'high' as severity, 'medium' as confidence, 1::bigint as start_line, len(string_split(content, chr(10)))::bigint as end_line from code_files where path like 'public/%'")
def rule_dom_xss(spark, sf_dir):
    return _rule(spark, sf_dir, "DOM XSS")


@query(f"{CORPUS} select path, 'high' as severity, 'medium' as confidence, 1::bigint as start_line, len(string_split(content, chr(10)))::bigint as end_line from code_files where contains(content, 'eval(')")
def rule_eval(spark, sf_dir):
    return _rule(spark, sf_dir, "Unsafe eval")


@query(f"{CORPUS} select path, 'critical' as severity, 'low' as confidence, 1::bigint as start_line, len(string_split(content, chr(10)))::bigint as end_line from code_files where contains(content, 'child_process.exec') or contains(content, 'require(''child_process'').exec')")
def rule_cmd_exec(spark, sf_dir):
    return _rule(spark, sf_dir, "Command Injection")


@query(f"""{CORPUS}, hits as (select path, content, unnest([case when path like 'public/%' then 'DOM XSS' end, case when contains(content, 'eval(') then 'Unsafe eval' end, case when contains(content, 'child_process.exec') then 'Command Injection' end]) as type from code_files)
select path, type, left(sha256(concat_ws('|', path, '0', type, '1', len(string_split(content, chr(10))), case type when 'DOM XSS' then 'external input may reach an HTML sink' when 'Unsafe eval' then 'eval runs text as code' else 'input may become part of a command' end, left(content, 50), '0', sha256(content))), 12) as id from hits where type is not null""")
def finding_ids(spark, sf_dir):
    return rules.analyze_chunks(chunks.build_chunks(code_files(spark, sf_dir))).select("path", "type", "id")


_SCORE = " + ".join(f"(case when contains(lower(path), '{k.lower()}') then 2 else 0 end) + (case when contains(lower(content), '{k.lower()}') then 1 else 0 end)" for k in relevance.KEYWORDS)


@query(f"{CORPUS} select path, ({_SCORE})::bigint as score from code_files where ({_SCORE}) > 0 order by score desc, path limit 20")
def relevance_top20(spark, sf_dir):
    return relevance.most_relevant(code_files(spark, sf_dir)).select("path", long("score").alias("score"))


@query(f"{CORPUS} select folder, path, score from (select *, row_number() over (partition by folder order by score desc, path) as n from (select regexp_extract(path, '^(.*)/', 1) as folder, path, ({_SCORE})::bigint as score from code_files) where score > 0) where n <= 20")
def relevance_top20_per_dir(spark, sf_dir):
    files = code_files(spark, sf_dir).withColumn("folder", F.regexp_extract("path", "^(.*)/", 1))
    return relevance.most_relevant(files, by=("folder",)).select("folder", "path", long("score").alias("score"))


@query(f"{CORPUS} select distinct '../utils/sessionUtils' as dependency from code_files where regexp_matches(content, '(requireAuth|checkSession)[^\\n]*sessionUtils|sessionUtils[^\\n]*(requireAuth|checkSession)') and not exists (select 1 from code_files where contains(lower(path), 'sessionutils'))")
def missing_dependencies(spark, sf_dir):
    return relevance.missing_dependencies(code_files(spark, sf_dir))


@query(f"{CORPUS}, p as (select path, regexp_extract(path, '^(.*)/', 1) as folder from code_files where path like 'src/auth/%'), flags as (select folder, bool_or(regexp_matches(content, '(?i)(sessionStorage|localStorage)\\.getItem\\s*\\(|document\\.cookie')) and bool_or(regexp_matches(content, '(?i)userType|role|isAdmin')) and bool_or(regexp_matches(content, '(?i)ADMIN|NAFAL')) as evidence from (select distinct folder from p) join code_files on starts_with(path, folder) group by folder) select path, evidence from p join flags using (folder)")
def storage_evidence(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return relevance.storage_evidence(findings.auth_primaries(files), files)


@query(f"{CORPUS}, l as (select path, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) as n from code_files), e as (select path, n, 'on' || regexp_extract(line, 'on(Click|Submit|Change)\\s*=\\s*\\{{\\s*([A-Za-z_]\\w*)\\s*\\}}', 1) as ui_event, regexp_extract(line, 'on(Click|Submit|Change)\\s*=\\s*\\{{\\s*([A-Za-z_]\\w*)\\s*\\}}', 2) as what from l where regexp_matches(line, 'on(Click|Submit|Change)\\s*=\\s*\\{{') union all select path, n, 'disabled', trim(regexp_extract(line, 'disabled\\s*=\\s*\\{{([^}}]+)\\}}', 1)) from l where regexp_matches(line, 'disabled\\s*=\\s*\\{{')) select path, n::bigint as line, ui_event, what from e")
def ui_handlers(spark, sf_dir):
    return candidates.ui_handlers(code_files(spark, sf_dir)).select("path", long("line").alias("line"), "ui_event", F.coalesce("handler_name", "disabled_expression").alias("what"))


# The calls of the corpus's templates: kind of file, first and last line, pattern, and what is told of each.
_CALLS = """calls as (select * from (values
    (0, 4, 4, 0, 'POST', '/api/orders/{orderId}/payment/~', 'amount,orderId,usePoints', 'axios.post', 'high', 'authorization not visible here'),
    (0, 2, 2, 6, 'UNKNOWN', 'UNKNOWN', 'amount,orderId', 'function_call', 'low', 'what the called function sends is not visible here;address not resolved'),
    (1, 2, 6, 2, 'POST', '/api/cart/#/items', 'JSON,accept,productId,quantity', 'fetch', 'high', 'authorization not visible here;parameters handed over as an object'),
    (1, 7, 7, 6, 'UNKNOWN', 'UNKNOWN', 'payload,total', 'function_call', 'low', 'what the called function sends is not visible here;address not resolved'),
    (8, 1, 1, 1, 'GET', '{API_BASE}/users/{userId}/orders?limit=10', 'limit', 'apiClient.get', 'high', 'address begins with a base variable;authorization not visible here'),
    (8, 2, 6, 4, 'PUT', '/v1/users/#/status', 'payload', 'apiClient.request', 'high', 'authorization not visible here;parameters handed over as an object'),
    (8, 2, 6, 5, 'PUT', '/v1/users/#/status', 'payload', 'request', 'high', 'authorization not visible here;parameters handed over as an object'),
    (8, 7, 7, 5, 'UNKNOWN', 'UNKNOWN', '', 'request', 'low', 'address not resolved;authorization not visible here;method not resolved'),
    (8, 8, 8, 0, 'GET', '/api/profile/#', 'page', 'axios.get', 'high', 'authorization not visible here'),
    (9, 3, 7, 3, 'POST', '/api/reset/#', 'form,type', '$.ajax', 'high', 'authorization not visible here;parameters handed over as an object'),
    (11, 41, 41, 0, 'DELETE', '/api/items/#', '', 'axios.delete', 'medium', 'authorization not visible here')
  ) as t(kind, a, b, pattern, method, endpoint, parameters, sink, confidence, notes)),
made as (select path, content, a, b, pattern, method, replace(replace(endpoint, '#', cast(o_orderkey as varchar)), '~', lower(o_orderstatus)) as endpoint, parameters, sink, confidence, notes, kind
  from calls join code on kind = o_orderkey % 12)"""
_CODE = f"with code as (select o_orderkey, o_orderstatus, {', '.join(corpus_columns())} from orders), {_CALLS}"


@query(f"{_CODE} select path, a as line, pattern, 0 as match, method, endpoint, parameters, a as start_line, b as end_line, array_to_string(string_split(content, chr(10))[a : b], chr(10)) as snippet, sink, confidence, notes from made")
def api_candidates(spark, sf_dir):
    rows = candidates.call_candidates(code_files(spark, sf_dir))
    return rows.withColumns({"parameters": F.array_join("parameters", ","), "notes": F.array_join("notes", ";")})


# What calls the corpus holds, told from its templates.
@query("""with k as (select o_orderkey as n, lower(o_orderstatus) as s from orders), c as (
  select 'axios.post' as sink, 'POST' as method, '/api/orders/{orderId}/payment/' || s as endpoint, 'amount,orderId,usePoints' as parameters, n from k where n % 12 = 0
  union all select 'fetch', 'POST', '/api/cart/' || n || '/items', 'JSON,accept,productId,quantity', n from k where n % 12 = 1
  union all select 'apiClient.get', 'GET', '{API_BASE}/users/{userId}/orders?limit=10', 'limit', n from k where n % 12 = 8
  union all select unnest(['apiClient.request', 'request']), 'PUT', '/v1/users/' || n || '/status', 'payload', n from k where n % 12 = 8
  union all select 'request', 'UNKNOWN', 'UNKNOWN', '', n from k where n % 12 = 8
  union all select 'axios.get', 'GET', '/api/profile/' || n, 'page', n from k where n % 12 = 8
  union all select '$.ajax', 'POST', '/api/reset/' || n, 'form,type', n from k where n % 12 = 9
  union all select 'axios.delete', 'DELETE', '/api/items/' || n, '', n from k where n % 12 = 11)
select sink, method, endpoint, parameters, count(*) as calls from c group by all""")
def api_params(spark, sf_dir):
    return candidates.api_calls(code_files(spark, sf_dir)).groupBy("sink", "method", "endpoint", F.array_join("parameters", ",").alias("parameters")).agg(F.count("*").alias("calls"))


@query("select o_orderkey, case o_orderkey % 5 when 0 then '/api/x/' || o_orderkey when 1 then '{API_BASE}/y' when 2 then '/v1/{id}/z' when 3 then 'UNKNOWN' else '/api/w' end as endpoint from orders")
def endpoint_normalize(spark, sf_dir):
    key, kind = F.col("o_orderkey"), F.col("o_orderkey") % 5
    raw = F.when(kind == 0, F.concat(F.lit("  https://h/api/x/"), key.cast("string"))).when(kind == 1, F.concat(F.lit("$"), F.lit("{API_BASE}/y"))).when(kind == 2, F.concat(F.lit("base + /v1/$"), F.lit("{id}/z"))).when(kind == 3, "some words here").otherwise(F.concat(F.lit("$"), F.lit("{apiBase}/api/w")))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.endpoint_of(raw)["endpoint"].alias("endpoint"))


@query(f"{CORPUS} select path, 'saveOrder' as name, 'payload,total' as parameters, 7::bigint as line from code_files where path like 'src/pay/g%' union all select path, 'handlePay', 'amount,orderId', 2::bigint from code_files where path like 'src/pay/f%'")
def wrapper_calls(spark, sf_dir):
    rows = candidates.wrapper_calls(code_files(spark, sf_dir))
    return rows.select("path", F.regexp_extract("snippet", r"([A-Za-z_]+)\(", 1).alias("name"), F.array_join("parameters", ",").alias("parameters"), long("line").alias("line"))


@query("select 'src/pay/f' || o_orderkey || '.js' as path, 'onClick' as ui_event, 'handlePay' as handler, '/api/orders/{orderId}/payment/' || lower(o_orderstatus) as endpoint from orders where o_orderkey % 12 = 0")
def disabled_ui_semijoin(spark, sf_dir):
    files = code_files(spark, sf_dir)
    rows = findings.disabled_findings(files, candidates.ui_handlers(files), candidates.api_calls(files))
    part = lambda n: F.regexp_replace(F.element_at("evidence.data_flow", n), "^[a-z_]+: ", "")
    return rows.select("path", part(2).alias("ui_event"), part(4).alias("handler"), part(5).alias("endpoint"))


@query("""with c as (select case o_orderkey % 12 when 0 then ['Payment/Point Manipulation Candidate'] when 1 then ['Client-side Validation Bypass'] when 8 then ['Generic API Review Candidate', 'Generic API Review Candidate', 'IDOR / Unauthorized Data Access Candidate', 'State/Status Manipulation Candidate', 'State/Status Manipulation Candidate'] when 9 then ['Account Recovery Flow Abuse Candidate'] when 11 then ['Client-side Validation Bypass'] else [] end as t from orders), u as (select unnest(t) as type from c)
select type, case type when 'Payment/Point Manipulation Candidate' then 'high' when 'State/Status Manipulation Candidate' then 'high' when 'Generic API Review Candidate' then 'low' else 'medium' end as severity, count(*) as n from u group by all""")
def candidate_classification(spark, sf_dir):
    kind = R.classify(F.col("method"), F.col("endpoint"), F.col("parameters"))
    rows = candidates.api_calls(code_files(spark, sf_dir)).withColumn("type", kind)
    return rows.groupBy("type", R.severity(F.col("type")).alias("severity")).agg(F.count("*").alias("n"))


@query("with c as (select unnest(case o_orderkey % 12 when 0 then ['high'] when 1 then ['high'] when 8 then ['high', 'high', 'high', 'low', 'high'] when 9 then ['high'] when 11 then ['medium'] else [] end) as confidence from orders) select confidence, count(*) as n from c group by 1")
def candidate_confidence(spark, sf_dir):
    return candidates.api_calls(code_files(spark, sf_dir)).groupBy("confidence").agg(F.count("*").alias("n"))


@query(f"{CORPUS} select case when contains(lower(content), 'navigate') and not regexp_matches(lower(content), 'requireauth|axios\\.|fetch\\(') then 'low' else 'high' end as severity, count(*) as files from code_files group by 1")
def severity_counts(spark, sf_dir):
    return code_files(spark, sf_dir).groupBy(R.auth_severity(F.col("content")).alias("severity")).agg(F.count("*").alias("files"))


# The findings of each file and how they merge: calls by their request, disabled controls by file, the other two rules as one each.
_FOUND = f"""{_CODE}, found as (
  select path, 0 as rule, 0 as place, 'Client-side Validation Bypass' as type, 'low' as severity, 'low' as confidence, null as method, 'UNKNOWN' as endpoint, null as parameters, null as sink, 1 as a, 7 as b, path || 'd' as seed, path as own from code where o_orderkey % 12 = 0
  union all select path, 1, 0, 'Authorization Bypass', 'high', 'low', null, null, null, null, 2, 8, path || 'a', '' from code where o_orderkey % 12 = 2
  union all select path, 2, 0, 'DOM XSS', 'high', 'medium', null, null, null, null, 1, 5, path || 'x', '' from code where o_orderkey % 12 = 5
  union all select path, 3, a * 10 + pattern, type, case type when 'Generic API Review Candidate' then 'low' when 'Payment/Point Manipulation Candidate' then 'high' when 'State/Status Manipulation Candidate' then 'high' else 'medium' end,
    case when endpoint = 'UNKNOWN' or method = 'DELETE' then 'low' else 'medium' end, method, endpoint, parameters, sink, a, b, concat_ws(':', path, method, endpoint, sink, parameters, type), ''
  from (select *, case when kind = 0 then 'Payment/Point Manipulation Candidate' when kind = 8 and a = 1 then 'IDOR / Unauthorized Data Access Candidate' when kind = 8 and a = 2 then 'State/Status Manipulation Candidate'
    when kind = 8 then 'Generic API Review Candidate' when kind = 9 then 'Account Recovery Flow Abuse Candidate' else 'Client-side Validation Bypass' end as type from made where sink <> 'function_call')),
merged as (select arg_min(struct_pack(seed, severity, confidence, path, a, b), struct_pack(path, rule, place)) as one, type, method, endpoint, parameters, sink, count(distinct path) as n_files, count(*) as merged, list_sort(list(distinct path)) as files from found group by type, method, endpoint, parameters, sink, own)"""


@query(f"{_FOUND} select left(sha256(one.seed), 12) as id, type, one.severity as severity, one.confidence as confidence, coalesce(endpoint, '') as endpoint, n_files, merged, least(5, merged) as pieces from merged")
def findings_dedup(spark, sf_dir):
    merged = findings.merge_findings(findings.file_findings(code_files(spark, sf_dir)), without=("notes", "code", "snippet", "data_flow"))
    return merged.select("id", "type", "severity", "confidence", F.array_join("endpoint", ",").alias("endpoint"), long("n_files").alias("n_files"), long("merged").alias("merged"), long(F.size("evidence")).alias("pieces"))


@query("select type, count(*) as findings from (select 'DOM XSS' as type, 1 from orders where o_orderkey % 12 = 5 limit 1) group by 1")
def dom_findings_merge(spark, sf_dir):
    files = code_files(spark, sf_dir)
    return findings.merge_findings(findings.dom_findings(files).select(*findings.COLUMNS)).groupBy("type").agg(F.count("*").alias("findings"))


@query(f"{_FOUND} select left(sha256(one.seed), 12) as id, type, one.severity as severity, one.confidence as confidence, one.path as path, one.a as start_line, one.b as end_line, coalesce(method, 'UNKNOWN') as method, coalesce(endpoint, 'UNKNOWN') as endpoint, coalesce(sink, 'N/A') as sink, case when coalesce(parameters, '') = '' then 'N/A' else replace(parameters, ',', ', ') end as parameters from merged")
def report_summary(spark, sf_dir):
    return findings.summary_card(findings.merge_findings(findings.file_findings(code_files(spark, sf_dir)), without=("notes", "code", "snippet", "data_flow")))


@query("select o_orderkey, '1' as amount, 'TEST_USER_ID' as user_id, 'TEST_VALUE' as other from orders")
def payload_template(spark, sf_dir):
    p = R.test_payload(F.array(F.lit("Amount"), F.lit("userId"), F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"))
    return rows.select("o_orderkey", F.element_at("p", "Amount").alias("amount"), F.element_at("p", "userId").alias("user_id"), F.element_at("p", F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))).alias("other"))


@query("select o_orderkey % 4 as kind, (o_orderkey % 4) in (1, 3) as risky, count(*) as n from orders group by all")
def high_risk_flag(spark, sf_dir):
    kind = F.col("o_orderkey") % 4
    method = F.when(kind == 1, "DELETE").otherwise("POST")
    endpoint = F.when(kind == 3, "/api/Refund/1").otherwise("/api/items")
    return table(spark, sf_dir, "orders").groupBy(kind.alias("kind"), R.high_risk(method, endpoint, F.array(F.lit("amount"))).alias("risky")).agg(F.count("*").alias("n"))


@query("select o_orderkey % 5 as kind, (o_orderkey % 5) in (0, 2, 4) as allowed, count(*) as n from orders group by all")
def poc_safety_filter(spark, sf_dir):
    kind = F.col("o_orderkey") % 5
    code = F.when(kind == 0, "fetch('/api/a')").when(kind == 1, "fetch('/api/a', { method: 'POST' })").when(kind == 2, "const CONFIRM_AUTHORIZED_TEST = false; if (!CONFIRM_AUTHORIZED_TEST) throw 1; axios.post('/a')").when(kind == 3, "navigator.sendBeacon('/a')").otherwise("/execute-query")
    return table(spark, sf_dir, "orders").groupBy(kind.alias("kind"), R.safe_to_show(code).alias("allowed")).agg(F.count("*").alias("n"))


@query("select event_id, json_extract(props, '$.k')::bigint as k from events")
def json_payload_extract(spark, sf_dir):
    kind, props = F.col("event_id") % 3, F.col("props")
    text = F.when(kind == 0, props).when(kind == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).otherwise(F.concat(F.lit("Here it is: "), props, F.lit(" as asked")))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(R.json_object(text), "$.k", "long").alias("k"))


@query("""select page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) as hash from pages""")
def prompt_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(escape_html(F.col("html")), 256).alias("hash"))


@query("select o_orderkey, 'a,b,c' as joined, 'b' as both, 'a' as left_only from orders")
def set_ops(spark, sf_dir):
    a, b = F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"), F.lit("b"))
    c = lambda x: F.array_join(F.array_sort(x), ",")
    return table(spark, sf_dir, "orders").select("o_orderkey", c(F.array_union(a, b)).alias("joined"), c(F.array_intersect(a, b)).alias("both"), c(F.array_except(a, b)).alias("left_only"))


@query(f"{CORPUS} select path, 1::bigint as start_line, least(case when path like 'src/auth/%' then 5 else 20 end, len(string_split(content, chr(10))))::bigint as end_line from code_files where path like 'src/auth/%' or path like 'lib/%'")
def first_hit_snippet(spark, sf_dir):
    files = code_files(spark, sf_dir).where("path like 'src/auth/%' or path like 'lib/%'")
    return files.select("path", relevance.first_hit(F.col("content"), relevance.AUTH_KEYS).alias("f")).select("path", long("f.start_line").alias("start_line"), long("f.end_line").alias("end_line"))


_AUTH = "|".join(k.lower().replace(".", "\\.") for k in relevance.AUTH_KEYS)


@query(f"""{CORPUS}, l as (select path, string_split(content, chr(10)) as ls from code_files), n as (select path, ls, unnest(range(len(ls))) as i from l), h as (select path, min(i) as i from n where regexp_matches(lower(ls[i + 1]), '{_AUTH}') group by path)
select path, (case when i is null then 1 else greatest(i - 4, 0) + 1 end)::bigint as start_line, (case when i is null then least(20, len(ls)) else least(i + 4, len(ls) - 1) + 1 end)::bigint as end_line from l left join h using (path)""")
def first_hit_snippet_all(spark, sf_dir):
    """first_hit_snippet over every file; the SQL of that query asks for two folders only."""
    files = code_files(spark, sf_dir).select("path", relevance.first_hit(F.col("content"), relevance.AUTH_KEYS).alias("f"))
    return files.select("path", long("f.start_line").alias("start_line"), long("f.end_line").alias("end_line"))


_KEYS = ", ".join(f"'{k.lower()}'" for k in relevance.SNIPPET_KEYS)
_NAMES = ", ".join(f"'{k}'" for k in relevance.SNIPPET_KEYS)


@query(f"""{CORPUS}, l as (select path, string_split(content, chr(10)) as ls from code_files), k as (select unnest([{_KEYS}]) as key, unnest([{_NAMES}]) as name, unnest(range({len(relevance.SNIPPET_KEYS)})) as ord),
  n as (select path, ls, unnest(range(len(ls))) as i from l), h as (select path, ls, greatest(i - 6, 0) as a, least(i + 6, len(ls) - 1) as b, ord * 1000 + i as pos, name from n join k on contains(lower(ls[i + 1]), key)),
  f as (select path, any_value(ls) as ls, a, b, min(pos) as pos, arg_min(name, pos) as keyword from h group by path, a, b), t as (select *, row_number() over (partition by path order by pos) as r from f)
select path, (a + 1)::bigint as start_line, (b + 1)::bigint as end_line, keyword, array_to_string(ls[a + 1 : b + 1], chr(10)) as snippet from t where r <= 5
union all select path, 1, least(20, len(ls)), null, array_to_string(ls[1 : 20], chr(10)) from l where path not in (select path from h)""")
def keyword_snippets_top5(spark, sf_dir):
    rows = relevance.keyword_snippets(code_files(spark, sf_dir))
    return rows.select("path", long("start_line").alias("start_line"), long("end_line").alias("end_line"), "keyword", "snippet")


@query("select 'src/pay/f' || o_orderkey || '.js' as path, 'handlePay' as name, 2::bigint as start_line, 6::bigint as end_line from orders where o_orderkey % 12 = 0")
def function_blocks(spark, sf_dir):
    files = code_files(spark, sf_dir)
    rows = blocks.function_blocks(files, candidates.api_calls(files)).where("name is not null")
    return rows.select("path", "name", long("start_line").alias("start_line"), long("end_line").alias("end_line"))


@query("select 'src/pay/f' || o_orderkey || '.js' as path, 3::bigint as line, 'amount' as watch from orders where o_orderkey % 12 = 0")
def validation_breakpoints(spark, sf_dir):
    files = code_files(spark, sf_dir)
    rows = blocks.guard_breakpoints(files, candidates.api_calls(files))
    return rows.select("path", long("line").alias("line"), F.array_join("watch", ",").alias("watch"))


@query("select 'src/auth/f' || o_orderkey || '.js' as path, 2::bigint as start_line, 8::bigint as end_line from orders where o_orderkey % 12 = 2")
def auth_branch_snippet(spark, sf_dir):
    rows = blocks.role_branches(code_files(spark, sf_dir).where("path like 'src/auth/%'"))
    return rows.select("path", long("start_line").alias("start_line"), long("end_line").alias("end_line"))


@query(f"{CORPUS} select path, case when path like 'src/auth/%' then 2 else 1 end::bigint as start_line, case when path like 'src/auth/%' then 8 else least(20, len(string_split(content, chr(10)))) end::bigint as end_line from code_files")
def auth_branch_snippet_all(spark, sf_dir):
    """auth_branch_snippet over every file; the SQL of that query asks for one folder only."""
    rows = blocks.role_branches(code_files(spark, sf_dir))
    return rows.select("path", long("start_line").alias("start_line"), long("end_line").alias("end_line"))


@query("select event_id, case event_id % 3 when 0 then 'accepted' else 'validation' end as stage from events")
def llm_item_validation(spark, sf_dir):
    item = F.concat(F.lit('{"findings": [{"title": "t", "source_path": "a", "start_line": 1, "end_line": "2", "vulnerability_type": "v", "severity": "'), F.when(F.col("event_id") % 3 == 1, "worst").otherwise("low"), F.lit('", "confidence": "low", "evidence": ['), F.when(F.col("event_id") % 3 == 2, F.col("props")).otherwise('3, {"source_path": "a", "start_line": 1, "end_line": 2, "snippet": "s", "reason": "r"}'), F.lit('], "attack_scenario": ["s"], "impact": "i", "root_cause": "r", "remediation": "m"}]}'))
    events = table(spark, sf_dir, "events").select("event_id", "props")
    events = events.repartition(parts_for(spark, events.count()), "event_id")  # a table in few files would be few tasks
    rows = reviewers.chunk_items(events.select("event_id", item.alias("answer")), ("event_id",))
    return rows.select("event_id", F.when(F.col("accepted"), "accepted").otherwise("validation").alias("stage"))


def _varied(kind: str) -> str:
    return f"with files as (select o_orderkey % 9 as p, o_orderkey % 12 as d, o_orderkey % 8 as q, o_orderkey as k, {', '.join(varied_columns(kind))} from orders)"


@query(f"{_varied('call')} select path, 'act' as name, p + 1 as start_line, p + d + q + 4 as end_line from files where k % 7 <> 0")
def function_blocks_varied(spark, sf_dir):
    files = varied_files(spark, sf_dir, "call")
    rows = blocks.function_blocks(files, candidates.api_calls(files)).where("name is not null")
    return rows.select("path", "name", long("start_line").alias("start_line"), long("end_line").alias("end_line"))


@query(f"{_varied('call')} select path, p + d + 3 as call_line, p + d + 2 as line, 'amount' as watch from files")
def guard_breakpoints_varied(spark, sf_dir):
    files = varied_files(spark, sf_dir, "call")
    rows = blocks.guard_breakpoints(files, candidates.api_calls(files))
    return rows.select("path", long("call_line").alias("call_line"), long("line").alias("line"), F.array_join("watch", ",").alias("watch"))


@query(f"{_varied('flow')} select path, greatest(1, p + d + 2 - 6) as start_line, least(p + d + q + 3, p + d + 2 + 6) as end_line from files where d + 1 <= 6")
def dom_flow_varied(spark, sf_dir):
    files = varied_files(spark, sf_dir, "flow").withColumn("f", rules.dom_flow(F.col("content"))).where("f is not null")
    return files.select("path", long("f.start_line").alias("start_line"), long("f.end_line").alias("end_line"))


# Lines: the import, p notes, the badge, d steps, the branch (line p + d + 3), two more, q steps, the end.  Up to three lines
# from the badge count as showing a role, and so does a branch that stands there: such a file gives its first 20 lines.  Else six
# lines around the branch are taken, from the first that shows none.
@query(f"{_varied('role')} select path, case when d < 3 then 1 else greatest(p + 6, p + d - 3) end as low, p + d + 3 as hit, case when d < 3 then least(20, p + d + q + 6) else least(p + d + 9, p + d + q + 6) end as end_line from files")
def role_branch_varied(spark, sf_dir):
    files = varied_files(spark, sf_dir, "role")
    hit = F.size(F.split(F.substring_index("content", "if (user.role", 1), "\n"))
    rows = blocks.role_branches(files, keep=(hit.alias("hit"),))
    return rows.select("path", long("start_line").alias("low"), long("hit").alias("hit"), long("end_line").alias("end_line"))


# The object stands 4 d + q + 2 lines above the call, the form d + 1: keys are sought in the 40 lines above, forms in the 10 above.
@query(f"{_varied('payload')} select path, array_to_string(list_sort(list_concat(['body'], case when 4 * d + q + 2 <= 40 then ['alpha', 'beta'] else [] end, case when d + 1 <= 10 then ['code'] else [] end)), ',') as parameters, p + 4 * d + q + 3 as line from files")
def payload_keys_varied(spark, sf_dir):
    calls = candidates.api_calls(varied_files(spark, sf_dir, "payload"))
    return calls.select("path", F.array_join("parameters", ",").alias("parameters"), long("line").alias("line"))


@query("""with p as (select l_orderkey, l_linenumber, l_orderkey % 4 as a, l_linenumber % 4 as u, (l_orderkey // 4) % 3 as v from lineitem)
select l_orderkey, l_linenumber, a - u < 0 or a - u + 1 - v < 0 as outside from p""")
def path_containment_varied(spark, sf_dir):
    """Paths that go down and up again, by the keys of the lines: folders a, then u up, then one down and v up."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    part = lambda text, n: F.repeat(F.lit(text), n.cast("int"))
    path = F.concat(part("d/", key % 4), part("../", line % 4), F.lit("./e//"), part("../", F.floor(key / 4) % 3), F.lit("x.js"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", escapes_base(path).alias("outside"))


@query("""with s as (select l_orderkey, list_distinct(list(cast(l_linenumber as varchar))) as a, list_distinct(list(cast(cast(floor(l_quantity) as bigint) % 7 as varchar))) as b from lineitem group by 1)
select l_orderkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') as joined, array_to_string(list_sort(list_intersect(a, b)), ',') as both, array_to_string(list_sort(list_filter(a, lambda x: not list_contains(b, x))), ',') as left_only from s""")
def set_ops_lines(spark, sf_dir):
    """Union, intersection and difference of the sets of line numbers and of quantities' remainders of each order."""
    a, b = F.collect_set(F.col("l_linenumber").cast("string")), F.collect_set((F.floor("l_quantity") % 7).cast("string"))
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(a.alias("a"), b.alias("b"))
    told = lambda x: F.array_join(F.array_sort(x), ",")
    return s.select("l_orderkey", told(F.array_union("a", "b")).alias("joined"), told(F.array_intersect("a", "b")).alias("both"), told(F.array_except("a", "b")).alias("left_only"))


def _analysis(spark, sf_dir):
    inventory = written(_inventory(spark, sf_dir), "inventory")  # each part of the report reads it
    loaded, skipped = filters.load(inventory, inventory)
    return analyze(inventory, loaded, skipped)


_TOP = _FOUND.replace("found as (", f"top as (select path from (select path, ({_SCORE})::bigint as score from code) where score > 0 order by score desc, path limit 20), found as (").replace("from found group by", "from found where path in (select path from top) group by")


@query(f"{_TOP} select left(sha256(one.seed), 12) as id, type, one.severity as severity, one.confidence as confidence, array_to_string(files[1 : 20], ',') as files, merged from merged")
def analyze_top20(spark, sf_dir):
    """Merged findings of the 20 most relevant files."""
    found = _analysis(spark, sf_dir).findings
    return found.select("id", "type", "severity", "confidence", F.array_join("affected_files", ",").alias("files"), long("merged").alias("merged"))


# The most relevant files are all of the kind that decides by a role.
@query(f"""{_TOP} select path, rule, 0::bigint as ord, 'auth_route_guard' as strategy, '[{{"start_line":1,"end_line":8,"reason":"branch on a role","watch":["userInfo","user","role","userType","isAdmin"]}}]' as breakpoints, null::varchar as code from found join top using (path) where rule = 1""")
def playbooks(spark, sf_dir):
    """How to verify the findings of the 20 most relevant files."""
    rows = _analysis(spark, sf_dir).playbooks
    return rows.select("path", "rule", long("ord").alias("ord"), "strategy", F.to_json("breakpoints").alias("breakpoints"), "code")


@query(f"{_DECIDED}, kept as (select path, content from decided where reason_code like 'INCLUDED%') select (select count(*) from decided) as total_files_scanned, count(*) as loaded_count, count(*) as total_chunks, cast(sum((path like 'public/%')::int + contains(content, 'eval(')::int + contains(content, 'child_process.exec')::int) as bigint) as finding_count from kept")
def report_counts(spark, sf_dir):
    return _analysis(spark, sf_dir).summary().drop("readable_finding_count")


@query()
def report_json(spark, sf_dir):
    """The one document of a report."""
    return _analysis(spark, sf_dir).json()


@query(f"""{_TOP}, decided as (select path, content, {_DECISION} as reason_code from (select *, regexp_extract(path, '[^/]+$') as name from code)), kept as (select * from decided where reason_code like 'INCLUDED%')
select 'inventory' as part, count(*) as rows from decided union all select 'loaded', count(*) from kept union all select 'skipped', count(*) from decided where reason_code like 'EXCLUDED%' union all select 'chunks', count(*) from kept
union all select 'chunk_findings', cast(sum((path like 'public/%')::int + contains(content, 'eval(')::int + contains(content, 'child_process.exec')::int) as bigint) from kept union all select 'findings', count(*) from merged union all select 'playbooks', count(*) from found join top using (path) where rule = 1""")
def report_document(spark, sf_dir):
    """The whole report, written as one document in pieces; how many rows of each part its manifest tells."""
    pieces = write_document(_analysis(spark, sf_dir), new_folder(spark, "document"))["pieces"]
    rows = spark.createDataFrame([(p["part"], p["rows"]) for p in pieces if "part" in p], "part string, rows long")
    return rows.groupBy("part").agg(F.sum("rows").alias("rows"))


@query(f"{CORPUS} select path, list_aggregate(list_sort(list_distinct(regexp_extract_all(content, '(?i)(axios\\.(post|put)|fetch)\\(\\s*[''`\"]([^''`\"]+)', 3))), 'string_agg', ',') as endpoints from code_files where regexp_matches(content, '(?i)(axios\\.(post|put)|fetch)\\(\\s*[''`\"]')")
def distinct_endpoints(spark, sf_dir):
    files = code_files(spark, sf_dir).withColumn("e", R.endpoints(F.col("content"))).where(F.size("e") > 0)
    return files.select("path", F.array_join("e", ",").alias("endpoints"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
