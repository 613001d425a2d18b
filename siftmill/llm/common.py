"""What the operators share: materialised tables in the shared folder and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.tables import written


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by the path that the session's file systems know."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, lost executors lose nothing.  ``siftmill.tables.release`` deletes what a session has written."""
    return written(df, label)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list (a long, b long), as (node, component): the smallest node
    that can be reached.  Nodes without edges do not occur; self-loops, repeats and null ends are dropped.

    Every round hooks each node to its smallest neighbour and then halves the paths (pointer jumping), so the number
    of rounds grows with the logarithm of the longest path.  Both sides of every join are written tables: a hub's rows
    meet in a plain sort-merge join, which adaptive execution splits.
    """
    pair = lambda x, y: [F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")]
    e = edges.where("a is not null and b is not null and a != b").select(*pair(F.col("a"), F.col("b"))).distinct()
    e = materialise(e, "edges")
    state = None
    while True:
        p = materialise(e.groupBy("hi").agg(F.min("lo").alias("m")), "parents")
        up = p.select(F.col("hi").alias("k"), F.col("m").alias("mm"))
        jumped = p.join(up, F.col("m") == F.col("k"), "left").select("hi", F.coalesce("mm", "m").alias("lo"))
        hooked = e.join(p.withColumnRenamed("hi", "k"), F.col("hi") == F.col("k")).where("lo != m").select(*pair(F.col("lo"), F.col("m")))
        e = materialise(jumped.union(hooked).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.hash("hi", "lo").cast("long")), F.sum(F.xxhash64("hi", "lo").bitwiseAND(0xFFFFFFFF))).first()
        if now == state or not now[0]:
            break
        state = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def slices(batches, rows: int = 256):
    """The batches in small parts, so that a task holds few texts at a time."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
