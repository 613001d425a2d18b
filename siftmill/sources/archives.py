"""Archives and folders as tables of entries."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.config import DEFAULT, EngineConfig
from siftmill.functions.text import extension
from siftmill.sources.zips import BROKEN, ENTRY, batches, directory_error, rejected


def read_archives(spark: SparkSession, path: str, config: EngineConfig = DEFAULT) -> DataFrame:
    """ZIP files below a path as rows of archive, raw and error; what is no ZIP or too large has an error and no bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    error = F.when(~F.lower("path").endswith(".zip"), "NOT_A_ZIP_NAME").when(F.col("length") > config.max_archive_bytes, "ARCHIVE_TOO_LARGE").when(F.substring("content", 1, 2) != F.expr("X'504B'"), "NOT_A_ZIP")
    return files.select(F.col("path").alias("archive"), F.when(error.isNull(), F.col("content")).alias("raw"), error.alias("error"))


def escapes_base(path: Column) -> Column:
    """Whether a relative path leaves the folder that it starts in."""

    def step(acc: Column, part: Column) -> Column:
        depth = acc["depth"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
        return F.struct(depth.alias("depth"), F.least(acc["low"], depth).alias("low"))

    return F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")), step, lambda acc: acc["low"] < 0)


def mode_error(attributes: Column) -> Column:
    """Error of an entry whose file mode is that of a link, device, pipe or socket."""
    kind = F.shiftrightunsigned(attributes, 16).bitwiseAND(F.lit(0xF000))
    return F.when(kind == 0xA000, "SYMLINK").when(kind.isin(0x2000, 0x6000, 0x1000, 0xC000), "SPECIAL_FILE")


def path_error(path: Column) -> Column:
    return F.when(path.startswith("/"), "ABSOLUTE_PATH").when(path.rlike("^[A-Za-z]:"), "ABSOLUTE_PATH").when(escapes_base(path), "OUTSIDE_BASE")


def settle(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of entries (ENTRY) the files (archive, path, size, raw) of the archives that break no rule, and the rejected archives (archive, error).

    Nothing is written to disk: unsafe paths and links are predicates.  The first violation in the order of the entries
    names the error; of entries with one path the last wins."""
    found = entries.withColumn("error", F.coalesce("error", path_error(F.col("path")), mode_error(F.col("attributes"))))
    rejected = found.where("error is not null").groupBy("archive").agg(F.min_by("error", "entry_ord").alias("error"))
    files = found.where("raw is not null").join(rejected.select("archive"), "archive", "left_anti")
    last = files.groupBy("archive", "path").agg(F.max_by(F.struct("size", "raw"), "entry_ord").alias("one"))
    return last.select("archive", "path", "one.size", "one.raw"), rejected


def expand_archives(archives: DataFrame, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``settle`` of archives (archive, raw, error) that are rows with all their bytes, as a stream of small ones has them; ``siftmill.sources.zips`` reads large ones by ranges."""

    def unpack(parts):
        for part in parts:
            for name, raw, error in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if error is None:
                    try:
                        with zipfile.ZipFile(io.BytesIO(raw)) as z:
                            infos = z.infolist()
                            error = directory_error(infos, config)
                            if error is None:
                                yield from batches(name, z, list(enumerate(infos)))
                    except BROKEN:
                        error = "BAD_ZIP"
                if error is not None:
                    yield rejected(name, error)

    return settle(archives.select("archive", "raw", "error").mapInArrow(unpack, ENTRY))


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder: archive (the folder), path below it, extension, size and raw."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    base = path.rstrip("/").removeprefix("file://")
    below = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), f"^{base}/", "")
    return files.select(F.lit(base).alias("archive"), below.alias("path"), extension(below).alias("extension"), F.col("length").alias("size"), F.col("content").alias("raw"))
