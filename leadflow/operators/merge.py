"""Upsert by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.plans.session import materialise


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], update_cols: list[str] | None = None, newest: str | None = None) -> DataFrame:
    """target with updates merged in: rows of a known key take update_cols (all but the keys if not given), other
    rows stay, new keys are added. Keys compare null to null. Of updates that repeat a key the one with the greatest
    `newest` counts; without that column, or where it ties, a repeated key fails the job."""
    cols = update_cols if update_cols is not None else [c for c in updates.columns if c not in keys]
    t = target.withColumn("_old", F.lit(True)).alias("t")
    at = W.partitionBy(*keys)
    if newest is not None:
        updates = updates.withColumn("_turn", F.rank().over(at.orderBy(F.col(newest).desc_nulls_last()))).where("_turn = 1").drop("_turn")
    once = F.when(F.count(F.lit(1)).over(at) == 1, True).otherwise(F.raise_error(F.lit("updates repeat a key")).cast("boolean"))
    u = updates.withColumn("_new", once).alias("u")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}"))
    both = t.join(u, same, "full")
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.when(F.col("t._old"), F.col(f"t.{c}")).otherwise(F.col(f"u.{c}")).alias(c))
        elif c in updates.columns:
            take = F.col("u._new") if c in cols else F.col("t._old").isNull()
            out.append(F.when(take, F.col(f"u.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            out.append(F.col(f"t.{c}"))
    return both.select(*out)


def write_buckets(df: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """A table cut into `buckets` folders by a hash of its keys, for upsert_buckets."""
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    dealt.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path)


def upsert_buckets(path: str, updates: DataFrame, keys: list[str], buckets: int = 64, update_cols: list[str] | None = None, newest: str | None = None) -> list[int]:
    """upsert() into a table of write_buckets: only buckets that the updates touch are read and rewritten, all others keep their
    files. Returns those buckets. keys and buckets must be the table's own."""
    spark = updates.sparkSession
    updates = materialise(updates.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")), "bucket-updates")
    touched = sorted(r[0] for r in updates.select("_bucket").distinct().collect())  # as many as there are buckets
    if not touched:
        return []
    held = spark.read.parquet(path).where(F.col("_bucket").isin(touched))
    merged = upsert(held, updates, keys, update_cols, newest) if update_cols is None else upsert(held, updates, keys, [*update_cols, "_bucket"], newest)
    whole = materialise(merged, "bucket-merged")  # a table cannot be read while it is overwritten
    whole.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)
    return touched
