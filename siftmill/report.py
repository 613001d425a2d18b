"""The whole analysis of a project: a report of lazy tables, its summary, and its sink."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields
from typing import Protocol

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.config import DEFAULT, EngineConfig
from siftmill.operators import reviewers
from siftmill.operators.candidates import call_candidates, ui_handlers
from siftmill.operators.chunks import build_chunks, chunk_counts, skipped_chunks
from siftmill.operators.filters import built_for_files, inventory_counts
from siftmill.operators.findings import findings_of, gated_calls, merge_findings, playbooks
from siftmill.operators.relevance import most_relevant
from siftmill.operators.rules import analyze_chunks, may_hit
from siftmill.sources.zips import opened
from siftmill.tables import metrics_of, written

FOCUS = ("authorization", "storage", "DOM sinks", "client-side validation", "requests")
NOTES = ("chunk_findings are those of the rules over chunks", "findings are those over whole files")


class StageError(RuntimeError):
    """A stage of an analysis failed; ``status`` is what a service would answer."""

    def __init__(self, stage: str, status: int, cause: Exception):
        super().__init__(f"{stage}: {cause}")
        self.stage, self.status = stage, status


STAGES = {"scan": 500, "load": 500, "chunks": 500, "chunk analysis": 502, "file analysis": 502}


def run_stage(stage: str, work: Callable[[], DataFrame | None]):
    """What ``work`` gives; its failure becomes a StageError.  A ValueError of the analysis of files is the caller's fault."""
    try:
        return work()
    except Exception as e:
        raise StageError(stage, 400 if stage == "file analysis" and isinstance(e, ValueError) else STAGES[stage], e) from e


@dataclass(frozen=True)
class Analysis:
    """Findings over files, how to verify them, and metrics (one row)."""

    findings: DataFrame
    playbooks: DataFrame
    metrics: DataFrame


class Analyzer(Protocol):
    """Analyses files (path, content)."""

    def __call__(self, files: DataFrame) -> Analysis: ...


_METRICS = "scope string, backend string, called boolean, call_count long, candidate_count long, raw_item_count long, accepted_item_count long, dropped_item_count long, drop_stages array<struct<drop_stage:string,n:long>>, errors array<string>"


def _metrics(spark: SparkSession, backend: str, candidates: int, raw: int, stages: dict[str, int], errors: list[str]) -> DataFrame:
    """One row of run metrics, of numbers that the run's own jobs have told."""
    stages = {k: n for k, n in sorted(stages.items()) if n}
    dropped = sum(stages.values())
    return spark.createDataFrame([("files", backend, True, 1, candidates, raw, raw - dropped, dropped, list(stages.items()), sorted(errors))], _METRICS)


def _rows() -> Column:
    return F.count(F.lit(1))


def _count(df: DataFrame) -> int:
    """Rows of a table, as told when it was written; only a table that was not is counted."""
    told = metrics_of(df).get("rows")
    return df.count() if told is None else told


def by_rules(files: DataFrame) -> Analysis:
    """The rules of this engine."""
    handlers, calls = ui_handlers(files), gated_calls(files)
    merged = written(merge_findings(findings_of(files, handlers, calls)), "merged", rows=_rows())
    return Analysis(merged, playbooks(files, handlers, calls), _metrics(files.sparkSession, "rules", _count(files), _count(merged), {}, []))


def by_model(model: Callable[[str], str], ledger: str | None = None) -> Analyzer:
    """Asks a model once about the calls of the files; its items are checked, and what is dropped is counted by stage.  With a ledger no prompt is asked twice (``reviewers.ask_once``)."""

    def run(files: DataFrame) -> Analysis:
        calls = written(call_candidates(files.where(~built_for_files(F.col("path"), F.col("content")))), "calls", rows=_rows())
        prompt = reviewers.calls_prompt(calls)
        asked = reviewers.ask_once(prompt, model, ledger) if ledger else reviewers.ask(prompt, model)
        failed = F.when(F.col("error").isNotNull(), F.concat(F.lit("call failed: "), "error")).when(~reviewers.is_payload(F.col("answer")), "the answer has no list of findings")
        answers = written(asked.withColumn("failed", failed), "answers", failed=F.collect_set("failed"))
        of = lambda stage: F.count_if(F.col("drop_stage") == stage)
        items = written(reviewers.review_items(answers), "items", rows=_rows(), shape=of("shape"), validation=of("validation"), scrubbed=F.count_if("scrubbed"))
        told = metrics_of(items)
        errors = [*metrics_of(answers)["failed"], *(["code that may not be shown was removed"] if told["scrubbed"] else [])]
        handlers = ui_handlers(files)
        metrics = _metrics(files.sparkSession, "model", _count(calls), told["rows"], {k: told[k] for k in ("shape", "validation")}, errors)
        return Analysis(items.where("drop_stage is null").drop("drop_stage"), playbooks(files, handlers, calls), metrics)

    return run


def analyzer(backend: str, model: Callable[[str], str] | None = None) -> Analyzer:
    """The analyzer of a name: rules, or model with the model to ask."""
    if backend == "rules":
        return by_rules
    if backend == "model" and model is not None:
        return by_model(model)
    raise ValueError(f"no such analyzer: {backend} (rules, or model with a model)")


def chunk_analyzer(backend: str, model: Callable[[str], str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The same for chunks: DataFrame of chunks to DataFrame of findings."""
    if backend == "rules":
        return analyze_chunks
    if backend == "model" and model is not None:
        return lambda chunks: reviewers.review_chunks(chunks, model)
    raise ValueError(f"no such analyzer: {backend} (rules, or model with a model)")


@dataclass(frozen=True)
class Report:
    """All parts of an analysis as lazy tables; texts of files and chunks are left out."""

    inventory: DataFrame
    counts: DataFrame
    loaded: DataFrame
    skipped: DataFrame
    chunks: DataFrame
    chunk_counts: DataFrame
    skipped_chunks: DataFrame
    chunk_findings: DataFrame
    findings: DataFrame
    playbooks: DataFrame
    metrics: DataFrame
    focus: tuple[str, ...] = FOCUS
    notes: tuple[str, ...] = NOTES

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: v for f in fields(self) if isinstance(v := getattr(self, f.name), DataFrame)}

    def summary(self) -> DataFrame:
        """One row of five counts; 0 where a part has nothing."""
        row = self.counts.select(F.coalesce("total_files_scanned", F.lit(0)).cast("long").alias("total_files_scanned"))
        row = row.crossJoin(F.broadcast(self.loaded.agg(F.count("*").alias("loaded_count"))))
        row = row.crossJoin(F.broadcast(self.chunk_counts.select(F.coalesce("total_chunks", F.lit(0)).alias("total_chunks"))))
        row = row.crossJoin(F.broadcast(self.chunk_findings.agg(F.count("*").alias("finding_count"))))
        return row.crossJoin(F.broadcast(self.findings.agg(F.count("*").alias("readable_finding_count"))))

    def json(self) -> DataFrame:
        """One row with a short JSON document: counts, metrics, focus, notes and the findings, which are of at most as many files as were chosen.  ``write_document`` has all parts."""
        rows = self.findings.agg(F.array_sort(F.collect_list(F.to_json(F.struct("*")))).alias("items"))
        row = self.summary().select(F.struct("*").alias("counts")).crossJoin(F.broadcast(self.metrics.select(F.struct("*").alias("metrics")))).crossJoin(F.broadcast(rows))
        lists = F.struct(F.array(*map(F.lit, self.focus)).alias("focus"), F.array(*map(F.lit, self.notes)).alias("notes"))
        head = F.to_json(F.struct("counts", "metrics", lists.alias("about")))
        return row.select(F.concat(F.substr(head, F.lit(1), F.length(head) - 1), F.lit(',"findings":['), F.array_join("items", ","), F.lit("]}")).alias("report"))


def analyze(inventory: DataFrame, loaded: DataFrame, skipped: DataFrame, config: EngineConfig = DEFAULT, files_by: Analyzer = by_rules, chunks_by: Callable[[DataFrame], DataFrame] = analyze_chunks, most: int = 20, by: tuple[str, ...] = ()) -> Report:
    """The report of a project: all files are counted, cut into chunks and searched by chunk; the ``most`` relevant ones (of each group of ``by``) are analysed as files."""
    chunks = build_chunks(loaded, config)
    searched = build_chunks(loaded.where(may_hit(F.col("content"))), config) if chunks_by is analyze_chunks else chunks
    chosen = run_stage("file analysis", lambda: written(most_relevant(loaded, most, by).select("path", "content"), "chosen", rows=_rows()))
    own = run_stage("file analysis", lambda: files_by(chosen))
    return Report(inventory.drop("raw"), inventory_counts(inventory), loaded.drop("content"), skipped, chunks.drop("content"), chunk_counts(loaded, config), skipped_chunks(chunks).drop("content"), run_stage("chunk analysis", lambda: chunks_by(searched)), own.findings, own.playbooks, own.metrics)


#: The parts of the document that have rows, with the columns that order them.
PARTS = {
    "inventory": ("path",), "loaded": ("path",), "skipped": ("path",), "chunks": ("path", "chunk_index"), "skipped_chunks": ("path", "chunk_index"),
    "chunk_findings": ("path", "chunk_index", "occurrence"), "findings": ("id",), "playbooks": ("path", "rule", "ord"),
}


def _fragments(table: DataFrame, order: tuple[str, ...], folder: str) -> list[tuple[int, int, int]]:
    """Write the rows as JSON, in order, one file a partition: number, rows and bytes of each that has any."""
    held = [c for c in order if c in table.columns]
    rows = table.select(*held, F.to_json(F.struct("*")).alias("_json")).repartitionByRange(*held).sortWithinPartitions(*held).select("_json")

    def write(batches):
        part = TaskContext.get().partitionId()
        files, base = opened(folder)
        files.create_dir(base, recursive=True)
        at, n, size = f"{base}/{uuid.uuid4().hex}", 0, 0
        with files.open_output_stream(at) as f:
            for batch in batches:
                if len(batch):
                    text = (",\n" * bool(n) + ",\n".join(batch.column(0).to_pylist())).encode()
                    f.write(text)
                    n, size = n + len(batch), size + len(text)
        if n:
            files.move(at, f"{base}/{part:08}.json")  # a task that is tried again replaces it
        else:
            files.delete_file(at)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, n, size)], names=["part", "rows", "bytes"])

    return sorted(tuple(r) for r in rows.mapInArrow(write, "part long, rows long, bytes long").where("rows > 0").collect())


def write_document(report: Report, folder: str) -> dict:
    """The whole report as one JSON document in pieces: each partition of each part writes its rows as a fragment, and manifest.json lists what
    stands where: pieces in order, each with offset, bytes and rows and either a file or a text.  Concatenated they are the document
    (``document``), with counts, metrics, focus, notes and every part.  The driver sees a row a fragment."""
    pieces, at = [], 0

    def add(size: int, **what) -> None:
        nonlocal at
        pieces.append({"offset": at, "bytes": size, **what})
        at += size

    def say(text: str) -> None:
        add(len(text.encode()), text=text)

    one = lambda df: json.loads(df.select(F.to_json(F.struct("*")).alias("j")).first().j)
    head = {"counts": one(report.summary()), "chunk_counts": one(report.chunk_counts), "metrics": one(report.metrics), "about": {"focus": report.focus, "notes": report.notes}}
    say(json.dumps(head)[:-1])
    tables, stage_of = report.tables(), _STAGE_OF
    for name, order in PARTS.items():
        found = run_stage(stage_of.get(name, "file analysis"), lambda: _fragments(tables[name], order, f"{folder}/{name}"))  # noqa: B023
        say(f',\n"{name}":[')
        for k, (part, n, size) in enumerate(found):
            if k:
                say(",\n")
            add(size, file=f"{name}/{part:08}.json", rows=n, part=name)
        say("]")
    say("}\n")
    manifest = {"bytes": at, "pieces": pieces}
    files, base = opened(folder)
    with files.open_output_stream(f"{base}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def document(folder: str, block: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of the document in a folder, in blocks: what a sink or a download writes one after the other."""
    files, base = opened(folder)
    with files.open_input_file(f"{base}/manifest.json") as f:
        pieces = json.loads(f.read())["pieces"]
    for piece in pieces:
        if "text" in piece:
            yield piece["text"].encode()
            continue
        with files.open_input_stream(f"{base}/{piece['file']}") as f:
            while data := f.read(block):
                yield data


_STAGE_OF = {"inventory": "scan", "counts": "scan", "loaded": "load", "skipped": "load", "chunks": "chunks", "chunk_counts": "chunks", "skipped_chunks": "chunks", "chunk_findings": "chunk analysis"}


def write_report(report: Report, folder: str, form: str = "json") -> None:
    """Each table of the report below a folder, the short document as text, and the whole one in pieces below ``document``; a failing part names its stage."""
    for name, table in report.tables().items():
        run_stage(_STAGE_OF.get(name, "file analysis"), lambda: table.write.mode("overwrite").format(form).save(f"{folder}/{name}"))  # noqa: B023
    run_stage("file analysis", lambda: report.json().coalesce(1).write.mode("overwrite").text(f"{folder}/report"))
    run_stage("file analysis", lambda: write_document(report, f"{folder}/document"))
