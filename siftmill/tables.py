"""Tables that are written once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


#: How many rows of a large table a task is given.
ROWS_A_TASK = 50_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """How many partitions a table of so many rows is dealt to: what a task holds does not grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.  Only a session on one machine that names none, as in tests, gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    held = getattr(spark, "_siftmill_dir", None)
    if held is None:
        held = spark._siftmill_dir = "file://" + tempfile.mkdtemp(prefix="siftmill-")
    return held


def _paths(spark: SparkSession) -> list[str]:
    if not hasattr(spark, "_siftmill_tables"):
        spark._siftmill_tables = []
    return spark._siftmill_tables


def new_folder(spark: SparkSession, label: str) -> str:
    """The path of a new folder in the shared one, which ``release`` deletes."""
    path = f"{shared_dir(spark)}/siftmill-{label}-{uuid.uuid4().hex}"
    _paths(spark).append(path)
    return path


def written(df: DataFrame, label: str, plain: bool = False, **observed: Column) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, and lost executors lose nothing.

    With ``plain`` no dictionaries are tried, for tables of texts that hardly repeat.

    ``observed`` are aggregates over the rows that the writing job itself tells (``metrics_of``), without another job."""
    spark = df.sparkSession
    path = new_folder(spark, label)
    schema, told = df.schema, Observation() if observed else None
    if observed:
        df = df.observe(told, *[c.alias(k) for k, c in observed.items()])
    df.write.options(**{"compression": "zstd", **({"parquet.enable.dictionary": "false"} if plain else {})}).parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._siftmill_metrics = told.get if observed else {}
    return out


def metrics_of(df: DataFrame) -> dict:
    """What was observed when ``written`` wrote the table; nothing for other tables."""
    return getattr(df, "_siftmill_metrics", {})


def mark(spark: SparkSession) -> int:
    """How many tables the session has written; ``release`` takes it."""
    return len(_paths(spark))


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written after a mark, once nothing reads them any more."""
    paths = _paths(spark)
    for path in paths[since:]:
        remove(spark, path)
    del paths[since:]


def release_one(spark: SparkSession, at: int) -> None:
    """Delete the one table written next after a mark."""
    remove(spark, _paths(spark).pop(at))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by the file system that it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
