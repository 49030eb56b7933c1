"""What jobs leave on disk on their way."""

import os
import re

import __spark_entry__
from pyspark.sql import functions as F

from leadflow.operators.components import connected_components
from leadflow.plans.session import shared_dir, shuffles_removed, store_repeats_once

SF = "/root/testdata/sf0.001"


def folder(spark) -> str:
    return shared_dir(spark).removeprefix("file:").replace("//", "/", 1)


def written(spark, make) -> list[str]:
    """Names of the tables that are there after make() and were not before."""
    before = set(os.listdir(folder(spark)))
    make()
    return sorted(set(os.listdir(folder(spark))) - before)


def test_a_round_of_components_replaces_the_one_before(spark):
    chain = spark.range(64).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert len(written(spark, lambda: connected_components(chain).count())) == 1


def shuffle_files(spark) -> int:
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(bool(re.match("shuffle_.*data", local.apply(i).getName())) for i in range(local.size()))


def test_shuffles_of_tables_on_the_way_do_not_stay(spark):
    before = shuffle_files(spark)
    with shuffles_removed(spark):
        connected_components(spark.range(500).select((F.col("id") % 50).alias("u"), F.col("id").alias("v")))
    assert shuffle_files(spark) <= before


def test_long_values_that_repeat_are_stored_once(spark, tmp_path):
    store_repeats_once(spark)
    rows = spark.range(40).coalesce(1).select("id", F.concat(F.repeat(F.md5((F.col("id") % 2).cast("string")), 1 << 15), F.lit("")).alias("long"))  # two values of 1 MB
    rows.write.option("compression", "none").parquet(str(tmp_path / "out"))
    assert sum(f.stat().st_size for f in (tmp_path / "out").iterdir()) < 10 << 20


def columns(spark, names: list[str]) -> dict[str, set]:
    return {n.rsplit("-", 1)[0]: set(spark.read.parquet(f"{folder(spark)}/{n}").columns) for n in names}


def test_evidence_of_components_is_not_written_on_the_way(spark):
    tables = columns(spark, written(spark, lambda: __spark_entry__.queries()["grown_identity_map"](spark, SF)))
    assert tables and not any(held & {"identity_evidence", "signals"} for held in tables.values())


def test_a_day_writes_what_it_reads(spark):
    tables = columns(spark, written(spark, lambda: __spark_entry__.queries()["assignments"](spark, SF)))
    assert len(tables["queue"]) == 12 and "priority_reasons" in tables["assignments"]
    assert not any(held & {"telefono_raw", "nombre_cliente", "customer_identity_id"} for held in tables.values())


def test_records_of_a_source_go_when_it_is_loaded(spark):
    names = written(spark, lambda: __spark_entry__.queries()["ingestion_log"](spark, SF).collect())
    assert {n.rsplit("-", 1)[0] for n in names} == {"files"}
