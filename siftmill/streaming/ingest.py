"""Archives as a stream: each micro-batch of ZIP files is unpacked, filtered and appended to an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siftmill.config import DEFAULT, EngineConfig
from siftmill.operators.filters import inventory
from siftmill.sources.archives import expand_archives
from siftmill.tables import mark, release, written

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch_archives(spark: SparkSession, folder: str, out: str, checkpoint: str, config: EngineConfig = DEFAULT) -> StreamingQuery:
    """Follow a folder of ZIP files.  Below ``out`` the folders files and rejected get one part per micro-batch; a batch that
    is tried again replaces its own part, so each archive is there once."""
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.zip").load(folder)

    def one(batch: DataFrame, number: int) -> None:
        error = F.when(F.col("length") > config.max_archive_bytes, "ARCHIVE_TOO_LARGE").when(F.substring("content", 1, 2) != F.expr("X'504B'"), "NOT_A_ZIP")
        archives = batch.select(F.col("path").alias("archive"), F.when(error.isNull(), F.col("content")).alias("raw"), error.alias("error"))
        since = mark(batch.sparkSession)
        archives = written(archives, "stream")  # two results read them; their bytes do not stay in memory
        entries, rejected = expand_archives(archives, config)
        inventory(entries, config).drop("raw").write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        release(batch.sparkSession, since)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
