"""Numbers of rows in an order, without a task for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.shared import staged


def numbered(rows: DataFrame, order: list[Column], groups: list[str], name: str = "number") -> DataFrame:
    """`rows` with their number, from 1, within their group in `order`, which begins with the groups. Ranges of the order are numbered each by itself, and counts of the
    ranges before are added; a range holds a bounded share of the rows, whatever the groups. Null groups are groups too."""
    ranged = staged(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__range", *groups).count().withColumn("__before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = ranged.withColumn("__within", F.row_number().over(Window.partitionBy("__range", *groups).orderBy(*order)))
    sides = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in groups]
    joined = within.alias("a").join(counts.alias("b"), [F.col("a.__range") == F.col("b.__range"), *sides])
    return joined.select(*(F.col(f"a.{c}") for c in rows.columns), (F.col("__within") + F.col("__before")).alias(name))
