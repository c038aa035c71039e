"""Numbers and neighbours of the rows of large groups: rows are ranged into buckets by their order, so that no group is sorted in one task.

Only what stands at the buckets' edges is put in order over a whole group: at most BUCKETS rows of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order's values, of equal width.
BUCKETS = 4096


def _bucketed(rows: DataFrame, order: str, buckets: int) -> DataFrame:
    """rows with _b: the range that the order's value falls to; null comes first, as in a sort."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // buckets))
    return rows.withColumn("_b", F.coalesce(F.floor((F.col(order) - F.lit(low)) / width), F.lit(-1)))


def numbered(rows: DataFrame, group: list[str], order: str, name: str = "nth", buckets: int = BUCKETS) -> DataFrame:
    """rows with name: their place in their group, from 1, by order (whole numbers). A null group is one more group."""
    rows = _bucketed(rows, order, buckets)
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(F.struct(*group, "_b").alias("_k"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(order))
    rows = rows.withColumn("_own", own).join(counts, F.struct(*[F.col(g) for g in group], F.col("_b")).eqNullSafe(F.col("_k")))
    return rows.withColumn(name, F.col("_own") + F.col("_before")).drop("_b", "_k", "_own", "_before")


def with_previous(rows: DataFrame, group: list[str], order: str, value: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """rows with name: value of the row before, in their group, by order (whole numbers, each once); null at a group's first row."""
    rows = _bucketed(rows, order, buckets)
    edge = F.max_by(F.struct(F.col(value).alias("v")), F.struct(order)).alias("_edge")
    edges = rows.groupBy(*group, "_b").agg(edge)
    edges = edges.select(F.struct(*group, "_b").alias("_k"), F.lag("_edge").over(Window.partitionBy(*group).orderBy("_b")).alias("_edge"))
    inside = Window.partitionBy(*group, "_b").orderBy(order)
    rows = rows.withColumn("_first", F.row_number().over(inside) == 1).withColumn("_lag", F.lag(value).over(inside))
    rows = rows.join(edges, F.struct(*[F.col(g) for g in group], F.col("_b")).eqNullSafe(F.col("_k")))
    before: Column = F.when(F.col("_first"), F.col("_edge.v")).otherwise(F.col("_lag"))
    return rows.withColumn(name, before).drop("_b", "_k", "_first", "_lag", "_edge")
