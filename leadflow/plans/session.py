"""Session helpers: where shared intermediate tables go, and how they are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
DICTIONARY = "parquet.dictionary.page.size"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only where none is set and
    Spark runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage like a reliable checkpoint: the files outlive any executor, and the
    columnar form is smaller than checkpointed rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialised = path
    return out


def rests_on(df: DataFrame, table: DataFrame) -> DataFrame:
    """df, whose rows come out of a table of materialise(): discard(df) removes that."""
    df._materialised = getattr(table, "_materialised", None)
    return df


def discard(df: DataFrame) -> None:
    """Remove the files of a table of materialise() that nothing reads any more; other frames stay as they are."""
    if path := getattr(df, "_materialised", None):
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside go when it ends. Otherwise those of every table written on the way stay until the
    driver happens to collect its garbage, though the tables themselves are what is read later."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def store_repeats_once(spark: SparkSession, longest: int = 64 << 20) -> None:
    """For frames whose rows repeat long values: whatever is written to Parquet in this session from now on keeps dictionaries
    of up to `longest` bytes a column chunk, unless the session has its own setting. Beyond the usual 1 MB every copy is written out."""
    if spark.conf.get(DICTIONARY, None) is None:
        spark.conf.set(DICTIONARY, str(longest))
