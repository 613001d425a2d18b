"""Findings over files: four rules, what verifies them, and their merging."""

from __future__ import annotations

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from siftmill.functions.requests import ENDPOINT_NOTE, UNKNOWN, auth_severity, classify, high_risk, severity, validation_parameters
from siftmill.functions.text import any_of, bind, extract_all, holds, lines_or_one, short_hash, texts
from siftmill.functions.verification import disabled_listing, guarded_request, read_request, request_observer
from siftmill.operators.blocks import guard_breakpoints, role_branches
from siftmill.operators.candidates import WRAPPER_NOTE, api_calls, call_candidates, has_call, has_control, ui_handlers, wrapper_calls
from siftmill.operators.filters import built_for_files
from siftmill.operators.relevance import dependency_marks, missing_dependencies, storage_evidence, storage_marks, top_lines
from siftmill.operators.rules import dom_flow
from siftmill.sources.zips import opened
from siftmill.tables import metrics_of, parts_for, remove, written

FLOW = "input to sink"
CALL_GATE = ("axios.", "fetch(", "apiclient.", "request.", "httpclient.", "client.", "$.ajax", "jquery.ajax", "formdata")
# The kinds that are merged by their requests, and their causes.
CAUSES = {
    "Payment/Point Manipulation Candidate": "request driven by client parameters",
    "IDOR / Unauthorized Data Access Candidate": "authorization of reads by identifier unclear",
    "State/Status Manipulation Candidate": "server validation of client-controlled values unclear",
    "Account Recovery Flow Abuse Candidate": "server validation of recovery codes unclear",
    "Client-side Validation Bypass": "validation relies on the client",
    "Generic API Review Candidate": "server validation cannot be told from the front end",
    "Authorization Bypass": "authorization is decided on the client",
    "DOM XSS": "external input reaches an HTML sink without encoding",
}
COLUMNS = ("path", "rule", "ord", "id", "type", "severity", "confidence", "cause", "evidence", "disabled", "notes", "code")
MOST_FILES = 20


def _cause(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CAUSES.items() for x in pair])[kind]


def evidence(start: Column, end: Column, snippet: Column, reason: str, flow: Column) -> Column:
    return F.struct(F.col("path").alias("path"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), snippet.alias("snippet"), F.lit(reason).alias("reason"), flow.alias("data_flow"))


def disabled_findings(files: DataFrame, handlers: DataFrame, calls: DataFrame) -> DataFrame:
    """Files with a disabled control, a click or submit handler and a call: the first of each."""
    order = F.struct("line", "handler")
    named = F.col("ui_event").isin("onClick", "onSubmit") & F.col("handler_name").isNotNull()
    of = handlers.groupBy("path").agg(F.min_by("disabled_expression", F.when(F.col("ui_event") == "disabled", order)).alias("expression"), F.min_by(F.struct("ui_event", "handler_name"), F.when(named, order)).alias("event"))
    first = calls.groupBy("path").agg(F.min_by("endpoint", F.struct("line", "pattern", "match")).alias("endpoint"))
    rows = files.where(has_control(F.col("content"))).join(of.where("expression is not null and event is not null"), "path").join(first, "path")
    top = bind(lines_or_one(F.col("content")), top_lines)
    flow = F.array(F.lit(FLOW), F.concat(F.lit("ui_event: "), "event.ui_event"), F.concat(F.lit("disabled_expression: "), "expression"), F.concat(F.lit("handler: "), "event.handler_name"), F.concat(F.lit("endpoint: "), "endpoint"))
    rows = rows.withColumn("top", top)
    own = evidence(F.col("top.start_line"), F.col("top.end_line"), F.col("top.snippet"), "disabled control", flow)
    return rows.select("path", F.lit(0).alias("rule"), F.lit(0).alias("ord"), short_hash(F.concat("path", F.lit("d"))).alias("id"), F.lit("Client-side Validation Bypass").alias("type"), F.lit("low").alias("severity"), F.lit("low").alias("confidence"), F.lit("restriction by an attribute of the UI").alias("cause"), own.alias("evidence"), F.col("path").alias("disabled"), texts().alias("notes"), F.lit(None).cast("string").alias("code"))


def auth_primaries(files: DataFrame) -> DataFrame:
    """The files whose content decides by a role in the client."""
    return files.where(has_role(F.lower("content")))


def has_role(low: Column) -> Column:
    """Whether a content in lower case decides by a role in the client."""
    return F.contains(low, F.lit("admin")) & holds(low, ("usertype", "role", "isadmin")) & holds(low, ("navigate", "requireauth", "관리자 권한"))


def auth_findings(files: DataFrame, everything: DataFrame) -> DataFrame:
    """Branches on a role in the client; confidence is medium only with evidence of storage beside them and no missing dependency."""
    primary = auth_primaries(files)
    proof = storage_evidence(primary, everything)
    missing = missing_dependencies(everything).agg((F.count("*") > 0).alias("missing"))
    places = role_branches(primary, keep=(auth_severity(F.col("content")).alias("severity"),))
    rows = places.join(proof, "path", "left").crossJoin(F.broadcast(missing))  # one row
    confidence = F.when(F.col("evidence") & ~F.col("missing"), "medium").otherwise("low")
    own = evidence(F.col("start_line"), F.col("end_line"), F.col("snippet"), "client-side role check", texts(FLOW))
    return rows.select("path", F.lit(1).alias("rule"), F.lit(0).alias("ord"), short_hash(F.concat("path", F.lit("a"))).alias("id"), F.lit("Authorization Bypass").alias("type"), "severity", confidence.alias("confidence"), F.lit(CAUSES["Authorization Bypass"]).alias("cause"), own.alias("evidence"), F.lit("").alias("disabled"), F.when(F.col("missing"), texts("a dependency is missing")).otherwise(texts()).alias("notes"), request_observer(F.lit("session")).alias("code"))


def may_flow(low: Column) -> Column:
    """Whether a content in lower case has a sink and a source."""
    return F.contains(low, F.lit("innerhtml")) & holds(low, ("location", "document.url", "input.value", "postmessage"))


def dom_findings(files: DataFrame) -> DataFrame:
    rows = files.where(may_flow(F.lower("content"))).withColumn("flow", dom_flow(F.col("content"))).where("flow is not null")
    own = evidence(F.col("flow.start_line"), F.col("flow.end_line"), F.col("flow.snippet"), "source beside a sink", texts(FLOW))
    return rows.select("path", F.lit(2).alias("rule"), F.lit(0).alias("ord"), short_hash(F.concat("path", F.lit("x"))).alias("id"), F.lit("DOM XSS").alias("type"), F.lit("high").alias("severity"), F.lit("medium").alias("confidence"), F.lit(CAUSES["DOM XSS"]).alias("cause"), own.alias("evidence"), F.lit("").alias("disabled"), texts().alias("notes"), F.lit(None).cast("string").alias("code"))


def passes(low: Column) -> Column:
    """The coarse test for calls of a content in lower case."""
    return any_of(low, CALL_GATE)


def gated_calls(files: DataFrame) -> DataFrame:
    """The calls of files with gated: whether ``call_findings`` takes the file's calls.  So it joins no files."""
    gate = ~built_for_files(F.col("path"), F.col("content")) & passes(F.lower("content"))
    return written(call_candidates(files.withColumn("gated", gate), keep=("gated",)), "calls")


def call_findings(files: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls of files that pass a coarse test; generic wrappers and reads of no importance give none."""
    rows = calls.where("sink != 'function_call'")
    rows = rows.where("gated") if "gated" in calls.columns else rows.join(files.where(passes(F.lower("content"))).select("path"), "path", "left_semi")
    names = F.when((F.size("parameters") > 0) | (F.col("method") == "GET"), F.col("parameters")).otherwise(validation_parameters(F.col("snippet")))
    rows = rows.withColumn("names", names).withColumn("type", classify(F.col("method"), F.col("endpoint"), F.col("parameters")))
    generic = (F.col("sink") == "$.ajax") & (F.col("endpoint") == UNKNOWN) & F.array_contains("notes", WRAPPER_NOTE)
    important = any_of(F.lower("endpoint"), ("session", "auth", "me", "profile", "wallet", "order")) | F.exists("names", lambda p: F.lower(p).isin("userid", "memberid", "accountid", "orderid", "paymentid")) | F.array_contains("notes", ENDPOINT_NOTE)
    rows = rows.where(~generic & ~((F.col("method") == "GET") & ~important))
    known, read, change = F.col("endpoint") != UNKNOWN, F.col("method") == "GET", F.col("method").isin("POST", "PUT", "PATCH")
    rows = rows.withColumn("shown", (read & known) | (change & known & ~F.col("endpoint").startswith("TEST_VALUE") & ~high_risk(F.col("method"), F.col("endpoint"), F.col("names"))))  # a column, as it is asked for three times
    shown = F.col("shown")
    flow = F.concat(texts(FLOW), F.array(F.concat(F.lit("method: "), "method"), F.concat(F.lit("endpoint: "), "endpoint")), F.transform("names", lambda p: F.concat(F.lit("parameter: "), p)), F.array(F.concat(F.lit("sink: "), "sink")))
    seed = F.concat_ws(":", "path", "method", "endpoint", "sink", F.array_join(F.sort_array("names"), ","), "type")
    own = evidence(F.col("start_line"), F.col("end_line"), F.col("snippet"), "request with checked values", flow)
    notes = F.array_compact(F.array(F.when(~known, ENDPOINT_NOTE), F.when(~shown & ~read, "irreversible or risky: no runnable verification")))
    code = F.when(shown & read, read_request(F.col("endpoint"))).when(shown, guarded_request(F.col("method"), F.col("endpoint"), F.col("names")))
    place = F.col("line") * 10000 + F.col("pattern") * 1000 + F.col("match")
    return rows.select("path", F.lit(3).alias("rule"), place.alias("ord"), short_hash(seed).alias("id"), "type", severity(F.col("type")).alias("severity"), F.when(shown, "medium").otherwise("low").alias("confidence"), _cause(F.col("type")).alias("cause"), own.alias("evidence"), F.lit("").alias("disabled"), notes.alias("notes"), code.alias("code"))


def marked(files: DataFrame) -> DataFrame:
    """path, content and, of each file, which rules take it, written by one pass over the files; every rule reads its own files there.

    The content is null where no rule takes the file: what others ask of such a file is among the marks."""
    low, content = F.col("_low"), F.col("content")
    own = ~built_for_files(F.col("path"), content, low)
    rows = files.select("path", "content").withColumn("_low", F.lower("content")).withColumn("_own", own)
    marks = {"_disabled": F.col("_own") & has_control(content), "_gated": F.col("_own") & holds(low, CALL_GATE), "_called": has_call(content), "_auth": F.col("_own") & has_role(low), "_dom": F.col("_own") & may_flow(low)}
    rows = rows.withColumns(marks | dependency_marks() | storage_marks(low))
    taken = F.col("_disabled") | (F.col("_gated") & F.col("_called")) | F.col("_auth") | F.col("_dom")
    return written(rows.withColumn("content", F.when(taken, content)).drop("_low", "_own"), "marked", plain=True)


def file_findings(files: DataFrame) -> DataFrame:
    """Findings of all rules before merging; path, rule and ord give their order.

    Files are read once (``marked``).  Calls are extracted once and written, as two rules read them: those of files that pass the
    coarse test and, for the first call beside a disabled control, all of files that have one."""
    rows = marked(files)
    controls = rows.where("_disabled")
    calls = api_calls(rows.where("_called and (_gated or _disabled)").withColumnRenamed("_gated", "gated"), keep=("gated",))
    more = wrapper_calls(controls.withColumnRenamed("_gated", "gated"), keep=("gated",))
    calls = written(calls.unionByName(more).drop("confidence"), "calls", plain=True)
    return _together(disabled_findings(controls, ui_handlers(controls), calls), auth_findings(rows.where("_auth"), rows), dom_findings(rows.where("_dom")), call_findings(rows, calls))


def findings_of(files: DataFrame, handlers: DataFrame, calls: DataFrame) -> DataFrame:
    own = files.where(~built_for_files(F.col("path"), F.col("content")))
    return _together(disabled_findings(own, handlers, calls), auth_findings(own, files), dom_findings(own), call_findings(own, calls))


def _together(*parts: DataFrame) -> DataFrame:
    return parts[0].select(*COLUMNS).unionByName(parts[1].select(*COLUMNS)).unionByName(parts[2].select(*COLUMNS)).unionByName(parts[3].select(*COLUMNS))


def _flow(name: str) -> Column:
    """Values of a key of the first evidence, for the kinds that are merged by their requests."""
    mark = f"{name}: "
    values = F.transform(F.filter("evidence.data_flow", lambda x: x.startswith(mark)), lambda x: F.substring(x, len(mark) + 1, 1 << 30))
    merged = tuple(k for k in CAUSES if k not in ("Authorization Bypass", "DOM XSS"))
    return F.when(F.col("type").isin(*merged), F.sort_array(values)).otherwise(texts())


def with_key(findings: DataFrame) -> DataFrame:
    """Add key (kind, request and cause, by which findings merge) and at (their order)."""
    key = F.struct("type", "cause", "disabled", *[_flow(k).alias(k) for k in ("method", "endpoint", "parameter", "sink")])
    return findings.withColumn("key", key).withColumn("at", F.struct("path", "rule", "ord"))


def summarise(findings: DataFrame, most_evidence: int = 5) -> DataFrame:
    """What merging needs of findings, one row per key and file: key, path, at, first, merged and pieces (the first pieces of evidence).

    Summaries add up (``combine``), so a new batch of files does not need the files before it again."""
    pieces = F.slice(F.array_sort(F.collect_list(F.struct("at", "evidence"))), 1, most_evidence)  # of one file
    first = F.min_by(F.struct("id", "severity", "confidence", "notes", "code"), "at").alias("first")
    return with_key(findings).groupBy("key", "path").agg(first, F.min("at").alias("at"), F.count("*").alias("merged"), pieces.alias("pieces"))


def combine(held: DataFrame, new: DataFrame, most_evidence: int = 5) -> DataFrame:
    """The summary of what two summaries are of.  A key and file that both have, as when a file's findings come in two parts, become one row."""
    pieces = F.slice(F.array_sort(F.flatten(F.collect_list("pieces"))), 1, most_evidence)  # at most so many of each summary
    return held.unionByName(new).groupBy("key", "path").agg(F.min_by("first", "at").alias("first"), F.min("at").alias("at"), F.sum("merged").alias("merged"), pieces.alias("pieces"))


def merged_of(summary: DataFrame, most_evidence: int = 5, most_files: int = MOST_FILES) -> DataFrame:
    """The merged findings of a summary, one row per kind, request and cause: the first finding's values, how many findings and files, and the first files and pieces of evidence.

    A key and file may have several rows.  A key that a third of all findings share is dealt out by file first: of each part of it only
    the first rows and its numbers come together.  Both times a task sorts a bounded number of rows once."""
    told = metrics_of(summary).get("rows")
    parts = parts_for(summary.sparkSession, summary.count() if told is None else told)
    rows = summary.withColumns({"_key": F.unhex(F.sha2(F.to_json("key"), 256)), "_part": F.pmod(F.xxhash64("path"), F.lit(parts))}).repartition(parts, "_key", "_part")
    order = Window.partitionBy("_key", "_part").orderBy("at")
    rows = rows.withColumn("n_files", F.coalesce(F.lag("path").over(order) != F.col("path"), F.lit(True)).cast("long"))  # 1 in the first row of a file
    rows = rows.withColumn("_new", F.col("n_files") == 1)
    rows = _numbered(rows, order, most_evidence, most_files).withColumns({"pieces": F.when(F.col("_n") <= most_evidence, F.col("pieces")), **{k: F.when(F.col("_n") == 1, F.col(k)).otherwise(0) for k in ("n_files", "merged")}})
    order = Window.partitionBy("_key").orderBy("at")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = _numbered(rows.repartition(parts, "_key"), order, most_evidence, most_files)  # few rows of each key
    paths = F.collect_list(F.when(F.col("_new") & (F.col("_file") <= most_files), F.col("path"))).over(whole)
    pieces = F.collect_list(F.when(F.col("_n") <= most_evidence, F.col("pieces"))).over(whole)
    out = rows.withColumns({"affected_files": paths, "pieces": pieces}).where("_n = 1")
    evidence = F.transform(F.slice(F.array_sort(F.flatten("pieces")), 1, most_evidence), lambda x: x["evidence"])
    return out.select("first.id", "key.type", "first.severity", "first.confidence", "key.cause", "key.method", "key.endpoint", "key.parameter", "key.sink", "affected_files", "n_files", "merged", evidence.alias("evidence"), *[f"first.{k}" for k in ("notes", "code") if k in summary.schema["first"].dataType.names], "at")


def _numbered(rows: DataFrame, order: WindowSpec, most_evidence: int, most_files: int) -> DataFrame:
    """The first rows and the first row of each of the first files, with their numbers _n and _file and the whole group's n_files and merged."""
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_n": F.row_number().over(order), "_file": F.sum(F.col("_new").cast("int")).over(so_far), **{k: F.sum(k).over(whole) for k in ("n_files", "merged")}})
    return rows.where((F.col("_n") <= most_evidence) | (F.col("_new") & (F.col("_file") <= most_files)))


def merge_findings(findings: DataFrame, most_evidence: int = 5, most_files: int = MOST_FILES, without: tuple[str, ...] = ()) -> DataFrame:
    """The findings merged (``merged_of``), each as a summary of itself; ``memberships`` has all files.

    What the caller does not read of notes, code and the evidence's fields may be named in ``without``: it is no column of the result
    then, and is neither made nor written nor shuffled on the way.  All findings are merged either way."""
    kept = lambda names: [c for c in names if c not in without]
    proof = F.struct(*[F.col(f"evidence.{k}") for k in kept(findings.schema["evidence"].dataType.names)]).alias("evidence")
    alone = F.array(F.struct("at", proof)).alias("pieces")
    first = F.struct("id", "severity", "confidence", *kept(("notes", "code"))).alias("first")
    own = with_key(findings).select("key", "path", "at", first, F.lit(1).cast("long").alias("merged"), alone)
    return merged_of(written(own, "found", plain=True, rows=F.count(F.lit(1))), most_evidence, most_files)


class FindingsOverTime:
    """Merged findings of batches of files that come one after another, kept as a summary below a folder.

    Every batch has a number.  The summary after it is written below ``summary=<number>`` from the one before and the batch alone,
    so a batch that is tried again replaces its own summary and counts once.  The one before last is kept for that; older ones are deleted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _numbers(self) -> list[int]:
        files, base = opened(self.folder)
        found = files.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        whole = [f for f in found if files.get_file_info(f"{f.path}/_SUCCESS").type == pafs.FileType.File]
        return sorted(int(f.base_name.removeprefix("summary=")) for f in whole if f.base_name.startswith("summary="))

    def add(self, findings: DataFrame, number: int) -> None:
        """Add the findings of batch ``number``; numbers rise."""
        before = [n for n in self._numbers() if n < number]
        new = summarise(findings)
        whole = combine(self.spark.read.parquet(f"{self.folder}/summary={before[-1]}"), new) if before else new
        whole.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.folder}/summary={number}")
        for n in before[:-1]:
            remove(self.spark, f"{self.folder}/summary={n}")

    def merged(self) -> DataFrame:
        """The merged findings of all batches so far."""
        return merged_of(self.spark.read.parquet(f"{self.folder}/summary={self._numbers()[-1]}"))


def memberships(findings: DataFrame) -> DataFrame:
    """Files of each merged finding: id (that of its first finding) and path, a row each."""
    keyed = written(with_key(findings).select("key", "path", "at", "id"), "members")
    return keyed.select("key", "path").distinct().join(keyed.groupBy("key").agg(F.min_by("id", "at").alias("id")), "key").select("id", "path")


def playbooks(files: DataFrame, handlers: DataFrame, calls: DataFrame) -> DataFrame:
    """How to verify what the rules find by hand: path, rule, ord (as in ``findings_of``), strategy, breakpoints, code and limits.

    A breakpoint is a struct of start_line, end_line, reason and watch (variables)."""
    own = files.where(~built_for_files(F.col("path"), F.col("content")))
    stop = lambda first, last, reason, watch: F.struct(first.cast("int").alias("start_line"), last.cast("int").alias("end_line"), F.lit(reason).alias("reason"), watch.alias("watch"))
    out = lambda rows, rule, ord_, strategy, stops, code, limits: rows.select("path", F.lit(rule).alias("rule"), ord_.alias("ord"), F.lit(strategy).alias("strategy"), stops.alias("breakpoints"), code.alias("code"), limits.alias("limits"))
    roles = auth_primaries(own).withColumn("n", F.size(lines_or_one(F.col("content"))))
    auth = out(roles, 1, F.lit(0), "auth_route_guard", F.array(stop(F.lit(1), F.col("n"), "branch on a role", texts("userInfo", "user", "role", "userType", "isAdmin"))), F.lit(None).cast("string"), texts())
    first = calls.groupBy("path").agg(F.min_by(F.struct("start_line", "end_line", "parameters"), F.struct("line", "pattern", "match")).alias("call"))
    controls = disabled_findings(own, handlers, calls).select("path").join(first, "path")
    disabled = out(controls, 0, F.lit(0), "disabled_button_bypass", F.array(stop(F.col("call.start_line"), F.col("call.end_line"), "before the request", F.concat(texts("payload"), "call.parameters"))), disabled_listing(), texts("the control's state may be kept elsewhere", "see the checks of its handler"))
    found = call_findings(own, calls).select("path", "ord")
    place = F.col("line") * 10000 + F.col("pattern") * 1000 + F.col("match")
    of = calls.withColumn("ord", place).join(found, ["path", "ord"], "left_semi")
    guards = guard_breakpoints(own, of).groupBy("path", "call_line").agg(F.array_sort(F.collect_list(F.struct("line", "watch"))).alias("guards"))  # at most as many as a function has lines
    of = of.join(guards.withColumnRenamed("call_line", "line"), ["path", "line"], "left")
    checks = F.coalesce(F.transform("guards", lambda g: stop(g["line"], g["line"], "a check that leaves early", g["watch"])), F.expr("cast(array() as array<struct<start_line:int,end_line:int,reason:string,watch:array<string>>>)"))
    watch = F.array_sort(F.array_distinct(F.concat(texts("payload"), "parameters", F.coalesce(F.flatten(F.transform("guards", lambda g: g["watch"])), texts()), extract_all(F.col("endpoint"), r"\{([^}]+)\}"))))
    stops = F.concat(checks, F.array(stop(F.col("start_line"), F.col("end_line"), "before the request", watch)))
    changed = out(of, 3, F.col("ord"), "breakpoint_payload_mutation", stops, request_observer(F.col("endpoint")), F.when(F.col("endpoint") == UNKNOWN, texts("the address is not known")).otherwise(texts()))
    return auth.unionByName(disabled).unionByName(changed)


def summary_card(merged: DataFrame) -> DataFrame:
    """What a reader sees of each finding: its first evidence and request, with UNKNOWN and N/A where there is none."""
    one = lambda c, d: F.coalesce(F.get(F.col(c), F.lit(0)), F.lit(d))
    place = F.get("evidence", F.lit(0))
    return merged.select("id", "type", "severity", "confidence", place["path"].alias("path"), place["start_line"].alias("start_line"), place["end_line"].alias("end_line"), one("method", UNKNOWN).alias("method"), one("endpoint", UNKNOWN).alias("endpoint"), one("sink", "N/A").alias("sink"), F.when(F.size("parameter") > 0, F.array_join("parameter", ", ")).otherwise("N/A").alias("parameters"))
