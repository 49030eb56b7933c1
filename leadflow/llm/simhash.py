"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Fingerprints at 3 or fewer differing bits agree
in one segment but for one bit at most, so looking up each segment and its ball of radius 1 in
the table of that segment finds every pair; the complete distance decides. Work is over distinct
fingerprints; copies hang on their smallest doc_id, so a group of equal texts costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import NULL_ID, keyed, may_be_among, pieces, whole_rows
from leadflow.operators.components import connected_components
from leadflow.plans.session import materialise

SEGMENT_BITS = 32
#: Two segments with balls of radius 1 are complete up to this distance.
COMPLETE_DISTANCE = 3


def shingle_hashes(text: str | None, k: int, seed: int) -> list[int]:
    """XXH64 of each k-word shingle of the lower-cased text (A-Z only), repeats included."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(joined, seed)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - k].tolist()]
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())]


def fingerprints_of(texts: list[str | None], k: int = 3, seed: int = 42) -> np.ndarray:
    """A 64-bit fingerprint (as int64) for each text; zero for texts without words."""
    return fingerprints_from([np.array(shingle_hashes(t, k, seed), np.uint64) for t in texts])


def fingerprints_from(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each list of shingle hashes."""
    counts = np.array([len(h) for h in hashes])
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        flat = np.concatenate(hashes).astype("<u8")
        starts = np.cumsum(counts[some]) - counts[some]
        ones = np.zeros((len(some), 64), np.int64)
        for byte in range(8):  # eight bits at a time keep the working array small
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8)[:, byte : byte + 1], axis=1, bitorder="little")
            ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        set_bits = 2 * ones > counts[some][:, None]
        out[some] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return out.view(np.int64)


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42) -> DataFrame:
    """documents -> doc_id, _d, _k (see common.keyed), fp (long). One row each, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                fp = fingerprints_of(batch.column("text").to_pylist(), k, seed)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "_d", "_k")), pa.array(fp)], names=["doc_id", "_d", "_k", "fp"])

    return keyed(docs).mapInArrow(run, "doc_id long, _d long, _k long, fp long")


def _segments(fp: Column) -> Column:
    """The two segments, told apart by their sign bit so that one key column serves both tables."""
    low = fp.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned(fp, SEGMENT_BITS)
    return F.array(low, F.bitwise_not(high))


def _ball(key: Column) -> Column:
    """A segment key and its neighbours at one bit, of which only those are taken that set a bit: for
    any two neighbours one does, so each pair is met once."""
    plain = F.when(key < 0, F.bitwise_not(key)).otherwise(key)
    free = F.filter(F.sequence(F.lit(0), F.lit(SEGMENT_BITS - 1)), lambda i: F.getbit(plain, i) == 0)
    bit = F.transform(free, lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i))
    near = F.transform(bit, lambda b: plain.bitwiseOR(b))
    return F.concat(F.array(key), F.transform(near, lambda x: F.when(key < 0, F.bitwise_not(x)).otherwise(x)))


def links(reps: DataFrame, distance: int = 3) -> DataFrame:
    """reps {fp (distinct), rep} -> pairs {u, v} of reps whose fingerprints differ in 1..distance bits."""
    if distance > COMPLETE_DISTANCE:
        raise ValueError(f"two segments with balls of radius 1 are complete up to {COMPLETE_DISTANCE} bits")
    tables = reps.select(F.explode(_segments(F.col("fp"))).alias("key"), F.col("fp").alias("fp_t"), F.col("rep").alias("v"))
    probes = reps.select("fp", F.col("rep").alias("u"), F.explode(_segments(F.col("fp"))).alias("own"))
    probes = probes.select("fp", "u", "own", F.explode(_ball(F.col("own"))).alias("key"))
    once = (F.col("key") != F.col("own")) | (F.col("u") < F.col("v"))
    met = probes.join(tables, "key").where((F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_t"))) <= distance) & (F.col("u") != F.col("v")) & once)
    return met.select("u", "v").distinct()


def grouped(docs: DataFrame, k: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """documents -> {doc_id, _d, _k, fp, first}; first: the smallest {_d, _k} of the group of near-duplicates."""
    marks = materialise(fingerprints(docs, k, seed), "simhash")
    reps = marks.groupBy("fp").agg(F.min(F.struct("_d", "_k")).alias("low"))
    found = connected_components(links(reps.select("fp", F.col("fp").alias("rep")), distance))
    component = reps.join(found, reps["fp"] == found["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("c"))
    least = component.groupBy("c").agg(F.min("low").alias("first"))
    return marks.join(component.join(least, "c").select("fp", "first"), "fp")


def near_duplicates(docs: DataFrame, k: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """documents -> doc_id, fingerprint (16 hex digits), component_id; one row per row of documents.

    component_id is the smallest doc_id reachable over links of `distance` or fewer bits, the
    document's own included. Null and empty texts have fingerprint zero and link like any other.
    A null doc_id comes before all others, and a component that holds one has a null component_id.
    Rows that share a doc_id are linked by their texts alone. Repeated rows get equal results.
    """
    named = F.when(F.col("first._d") != NULL_ID, F.col("first._d"))
    return grouped(docs, k, seed, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), named.alias("component_id"))


def keep_first(docs: DataFrame, k: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """docs reduced to the first document of each group of near-duplicates: that of the smallest doc_id and, among
    rows that share it, of the smallest hash of the text. All columns stay. Repeated rows of it are reduced to one."""
    return first_of(docs, grouped(docs, k, seed, distance))


def first_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs reduced to the documents that are the first of their own row in groups {_d, _k, first}."""
    key = ["_d", "_k"]
    told = groups.groupBy(*key).agg(F.count("*").alias("n"), F.max(F.struct(*key) == F.col("first")).alias("stays")).where("n > 1 or not stays")
    told = materialise(told, "first-of")
    held = may_be_among(whole_rows(docs), told, key)
    met = held.where("_maybe").join(told, key, "left").where("stays is null or stays")
    again = met.where("n > 1").dropDuplicates(key)
    return reduce(DataFrame.unionByName, [x.select("row.*") for x in (held.where("not _maybe"), met.where("n is null or n = 1"), again)])
