"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.plans.session import discard, materialise


def _settled(edges: DataFrame) -> bool:
    """Whether edges {u, v < u} are stars: each u has one v, and no u is a v."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("end"))
    ends = ends.groupBy("end.x").agg(F.sum("end.out").alias("out"), F.max("end.into").alias("into"))
    return ends.where("out > 1 or (out = 1 and into = 1)").agg(F.count("*")).first()[0] == 0


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows (itself included); rows may repeat."""
    both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node u hands its neighbours v < u, and itself, to the smallest of them."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges {u, v} (any ordered type) -> {node, component}: the smallest node reachable.

    Edges with a null end and self-loops are ignored; nodes without edges do not appear.
    Every node's neighbours are reduced with groupBy(min), so a node with very many
    neighbours is combined map-side and its rows are only joined back (AQE may split them).
    Each round is written to the shared folder in place of the one before, and ends if only stars are left; one
    number a round reaches the driver, and a round has few shuffles, as each costs the driver its tasks.
    """
    now = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialise(now, "cc-edges")
    for _ in range(max_rounds):
        if _settled(now):
            break
        now, before = materialise(_small_star(_large_star(now)), "cc-edges"), now
        discard(before)
    else:
        raise RuntimeError("components did not converge")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.unionByName(roots)
