"""Small pieces that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A row of documents is known by its id and its text: repeated rows share both and get equal results.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text with `_d` (the id; null becomes the smallest long) and `_k` (a hash of the text)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_d"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_k"),
    )


def whole_rows(docs: DataFrame) -> DataFrame:
    """docs as {row (a struct of all columns), _d, _k}: no name of theirs can clash with one that is added."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_d"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_k"),
    )


def spare_name(taken: list[str], name: str) -> str:
    """`name`, or a longer one where a column has it already (Spark compares without case)."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name += "_"
    return name


#: Bits of the map in may_be_among: 2 MB, whatever the number of keys.
MAP_BITS = 1 << 24


def may_be_among(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """df with `_maybe`: true in every row whose key is among those of `keys`, and in few others as long as keys are few for
    the map. A bit a key, in a map of fixed size, spares rows that no join concerns the shuffle; a join decides about the rest."""
    bit = F.pmod(F.xxhash64(*key), F.lit(MAP_BITS)) + 1
    bits = keys.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_map"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_map", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = df.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bits), "_bucket", "left")
    return met.withColumn("_maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_bucket", "_map")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500, size: str = "4m") -> Iterator[None]:
    """While this lasts, jobs send rows to Python in batches of so many rows and bytes at most: a batch stands in memory on
    both sides. The session's settings come back afterwards, so only what is written meanwhile is affected."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    held = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def give_back() -> None:
    """Gives memory that has been freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # only glibc has this call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving memory that it has freed back to the system at its end: Python workers outlive a task, and what the
    allocators keep of one stage would stand beside the next one's."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


def pieces(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about most_bytes of text each (one row at least), so that working arrays stay small."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def crc32_sql(x: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text, a bit at a time (polynomial 0xEDB88320)."""
    byte = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, j: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)"
    each = f"list_transform(string_split({x}, ''), lambda ch: cast(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 AS BIGINT), {each}), lambda c, b: {byte}), 4294967295)"
