"""Overlapping chunks of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.config import DEFAULT, EngineConfig
from siftmill.functions.text import joined, split_lines


def chunk_frames(n: Column, config: EngineConfig) -> Column:
    """Array of structs start_line, end_line (from 1, inclusive) for a file of n lines."""
    step = config.chunk_lines - config.overlap_lines
    last = F.greatest(F.lit(0), F.ceil((n - config.chunk_lines) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((1 + k * step).alias("start_line"), F.least(k * step + config.chunk_lines, n).alias("end_line")))


def build_chunks(files: DataFrame, config: EngineConfig = DEFAULT, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """One row per chunk of the files whose content is not empty: the columns of ``keep``, chunk_index, total_chunks, start_line, end_line, chunk_hash and content."""
    lined = files.where("content != ''").select(*keep, split_lines(F.col("content")).alias("lines"))
    lined = lined.withColumn("frames", chunk_frames(F.size("lines"), config))
    parts = F.transform("frames", lambda f: F.struct(f["start_line"].alias("start_line"), f["end_line"].alias("end_line"), joined(F.slice("lines", f["start_line"], f["end_line"] - f["start_line"] + 1)).alias("content")))
    rows = lined.select(*keep, F.size("frames").alias("total_chunks"), F.posexplode(parts).alias("chunk_index", "part"))
    return rows.select(*keep, "chunk_index", "total_chunks", "part.start_line", "part.end_line", F.sha2("part.content", 256).alias("chunk_hash"), "part.content")


def skipped_chunks(chunks: DataFrame) -> DataFrame:
    """The chunks without content, which no rule and no model sees."""
    return chunks.where("content = ''")


def chunk_counts(files: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    cut = F.size(chunk_frames(F.size(split_lines(F.col("content"))), config))
    n = F.when(F.col("content") == "", 0).when(F.length("content") <= config.chunk_lines, 1).otherwise(cut)  # no more lines than letters
    n = F.coalesce(n, F.lit(0))
    return files.select(n.alias("n")).agg(F.count("*").alias("total_files"), F.sum("n").cast("long").alias("total_chunks"), F.count_if(F.col("n") > 0).alias("files_chunked"), F.count_if(F.col("n") == 0).alias("files_skipped"))
