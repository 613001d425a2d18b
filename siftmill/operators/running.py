"""Running sums over groups of any size, without a window that puts a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftmill.tables import written


def running_sums(rows: DataFrame, by: list[str], order: list[Column], values: dict[str, Column | str], parts: int | None = None) -> DataFrame:
    """``rows`` with, for each name in ``values``, the sum of its value over the group's rows up to and with each row, in ``order``.

    The rows are dealt to ranges of (by, order), so that a large group has many ranges.  Each range sums its own rows, and the
    totals of the group's earlier ranges, one row a range and group, are added.  ``by`` may be empty: all rows are one group.  Rows that agree in the group and the whole
    order lie in one range and are summed in any order.  Pass light rows: they are written once and shuffled twice.  Null
    values count as nothing; an empty table gives no rows."""
    keys, n = [F.col(b) for b in by], range(len(values))
    dealt = rows.withColumns({f"_value{k}": F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)).cast("long") for k, v in enumerate(values.values())})
    dealt = dealt.repartitionByRange(*([parts] if parts else []), *keys, *order).withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    totals = dealt.groupBy("_range", *by).agg(*[F.sum(f"_value{k}").alias(f"_total{k}") for k in n])
    earlier = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("_range", *by, *[F.coalesce(F.sum(f"_total{k}").over(earlier), F.lit(0)).alias(f"_before{k}") for k in n])
    own = W.partitionBy("_range", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    dealt = dealt.select("*", *[F.sum(f"_value{k}").over(own).alias(f"_own{k}") for k in n])
    same = [F.col(f"x.{b}").eqNullSafe(F.col(f"y.{b}")) for b in by]
    joined = dealt.alias("x").join(before.alias("y"), [F.col("x._range") == F.col("y._range"), *same])
    return joined.select(*[F.col(f"x.`{c}`") for c in rows.columns], *[(F.col(f"x._own{k}") + F.col(f"y._before{k}")).alias(name) for k, name in enumerate(values)])


def running_sum(rows: DataFrame, by: list[str], order: list[Column], value: Column | str, name: str, parts: int | None = None) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(rows, by, order, {name: value}, parts)
