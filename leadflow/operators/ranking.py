"""Ranks over all rows, or inside groups, without one task that sorts all rows or a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.plans.session import materialise


def ranges(df: DataFrame) -> int:
    """How many ranges rows are cut into: the session's number of shuffle partitions."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def group_rank(df: DataFrame, group: list[Column], order: list[Column], name: str = "rank", size: str | None = None, count: int | None = None) -> DataFrame:
    """df with `name`: row_number inside `group` in `order` (total; ties must be broken by its last columns), from 1;
    with `size`, also the number of rows of the group.

    Rows are cut into ranges of (group, order) by Spark's range partitioner, so a group that holds most rows
    spans many tasks; each piece of a group is ranked by itself and shifted by the rows of that group in earlier
    ranges. The ranges are written once, since their bounds come from a sample and rank and count must agree on
    them: give this a narrow frame and join the rest back.
    """
    key = F.struct(*[g.alias(f"g{i}") for i, g in enumerate(group)]) if group else F.struct(F.lit(0).alias("g0"))
    ranged = df.withColumn("_group", key).repartitionByRange(count or ranges(df), F.col("_group"), *order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    inside = ranged.withColumn("_inside", F.row_number().over(W.partitionBy("_part", "_group").orderBy(*order)))
    pieces = ranged.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy("_group")  # a row for each range that the group spans
    earlier = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = pieces.select("_group", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_size"))
    out = inside.join(shift, ["_part", "_group"]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
    if size:
        out = out.withColumn(size, F.col("_size").cast("long"))
    return out.drop("_part", "_group", "_inside", "_before", "_size")


def global_rank(df: DataFrame, bucket: list[Column], order: list[Column], name: str = "rank", buckets: int | None = None) -> DataFrame:
    """df with `name`: row_number over all rows in (bucket, order); see group_rank."""
    return group_rank(df, [], [*bucket, *order], name, count=buckets)


def exact_percentile(df: DataFrame, column: str, q: float) -> float | None:
    """The exact percentile of a column, between its neighbours as Spark's percentile does; null without values.

    Values are ranked in ranges and the two that matter are looked up, so no task holds all of them."""
    ranked = group_rank(df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v")), [], [F.col("v")], "r", size="n")
    at = (F.col("n") - 1) * F.lit(float(q)) + 1
    near = ranked.where((F.col("r") == F.floor(at)) | (F.col("r") == F.ceil(at))).select("r", "v", at.alias("at")).collect()  # two rows at most
    if not near:
        return None
    low, high = min(near, key=lambda r: r["r"]), max(near, key=lambda r: r["r"])
    return low["v"] + (high["v"] - low["v"]) * (low["at"] - low["r"])
