"""Exact nearest strings by common subsequence, without comparing every pair.

The score of two strings is 2 LCS / (sum of lengths). len(a) + len(b) - 2 LCS is a metric, so distances to a few
pivot strings bound the score of a string with any block of names from above. Names are dealt into blocks of
about equal length and pivot distances. Each key first sees the blocks of the highest bounds, until they hold
enough names; its k-th best score there then says which other blocks can still matter, and only those are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.plans.session import materialise

#: Pivots, the sample they are chosen from, names of a block, keys that meet a block together, and blocks at most
#: (beyond them blocks grow). They change times, not results.
PIVOTS, SAMPLE, BLOCK, TOGETHER, MOST_BLOCKS = 16, 1000, 256, 64, 100_000
FIRST_BLOCKS = 3


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


@dataclass
class Names:
    """Names side by side, as columns of characters."""

    text: list[str]
    codes: np.ndarray
    length: np.ndarray

    @classmethod
    def of(cls, text: list[str]) -> "Names":
        length = np.array([len(t) for t in text], np.int64)
        codes = np.zeros((int(length.max(initial=0)), len(text)), np.int64)
        for i, t in enumerate(text):
            codes[: len(t), i] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        return cls(text, codes, length)

    def common(self, a: str) -> np.ndarray:
        """LCS of `a` with each name. Up to 63 characters all names are worked on at once, in one 64-bit word each."""
        if len(a) > 63:
            return np.array([lcs(a, t) for t in self.text], np.int64)
        letters = sorted(set(a))
        known = np.array([0, *map(ord, letters)], np.int64)
        masks = np.array([0, *[sum(1 << i for i, x in enumerate(a) if x == c) for c in letters]], np.uint64)
        v = np.full(len(self.text), (1 << 64) - 1, np.uint64)
        at = np.minimum(np.searchsorted(known, self.codes), len(known) - 1)
        steps = np.where(known[at] == self.codes, masks[at], np.uint64(0))
        for m in steps:
            u = v & m
            v = (v + u) | (v - u)
        used = v & np.uint64((1 << len(a)) - 1)
        return len(a) - np.bitwise_count(used).astype(np.int64)

    def distance(self, a: str) -> np.ndarray:
        return self.length + len(a) - 2 * self.common(a)


def choose_pivots(sample: list[str], most: int = PIVOTS) -> list[str]:
    """Strings far from each other: each next one is the farthest from those before (the first: the first in order)."""
    sample = sorted(set(sample))
    if not sample:
        return []
    names, chosen = Names.of(sample), [sample[0]]
    near = names.distance(sample[0])
    while len(chosen) < most and near.max() > 0:
        chosen.append(sample[int(near.argmax())])
        near = np.minimum(near, names.distance(chosen[-1]))
    return chosen


def upper_bounds(length: int, distance: np.ndarray, blocks: dict[str, np.ndarray]) -> np.ndarray:
    """The most that a key of this length and these pivot distances can score in each block."""
    away = np.maximum(np.maximum(blocks["lo"] - distance, distance - blocks["hi"]).max(1, initial=0), 0)
    best = np.clip(length + away, blocks["shortest"], blocks["longest"])
    total = best + length
    return np.where(total > 0, 1 - np.maximum(away, np.abs(length - best)) / np.maximum(total, 1), 0.0)


def _blocks(names: DataFrame, pivots: list[str]) -> DataFrame:
    """{block, shortest, longest, lo, hi, n, ids, texts}: names of about equal length and distance to their nearest pivot."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("name").to_pylist()
            if text:
                held = Names.of(text)
                d = np.stack([held.distance(p) for p in pivots], 1)
                cells = [d.argmin(1), held.length, d.min(1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c.astype(np.int32)) for c in cells], pa.array(list(d.astype(np.int32)), pa.list_(pa.int32()))], names=[*batch.schema.names, "pivot", "length", "d", "distance"])

    told = materialise(names.select("id", "name").mapInArrow(near, "id string, name string, pivot int, length int, d int, distance array<int>"), "similar-names")
    step = lambda c: F.floor(F.log(1.2, F.col(c) + 1)).cast("int")  # noqa: E731  few classes, however long the names
    cell = told.withColumn("cell", F.struct("pivot", step("length").alias("length"), step("d").alias("d")))
    size = max(BLOCK, -(-told.count() // MOST_BLOCKS))
    sizes = cell.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    dealt = cell.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("_parts")))
    ends = lambda f: F.array(*[f(F.col("distance")[i]) for i in range(len(pivots))])
    packed = F.array_sort(F.collect_list(F.struct("id", "name")))  # about BLOCK names
    out = dealt.groupBy("cell", "part").agg(F.min("length").alias("shortest"), F.max("length").alias("longest"), ends(F.min).alias("lo"), ends(F.max).alias("hi"), F.count(F.lit(1)).alias("n"), packed.alias("names"))
    return out.select(F.xxhash64("cell", "part").alias("block"), "shortest", "longest", "lo", "hi", "n", F.col("names.id").alias("ids"), F.col("names.name").alias("texts"))


def _scored(visits: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """visits {key, block} -> {key, id, name, score}: the k best of each block for each key. Keys that visit a block come to it
    in packs, so a block that all keys visit is read by many tasks, each time for many keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for keys, ids, texts in zip(*(batch.column(c).to_pylist() for c in ("keys", "ids", "texts"))):
                held, rank = Names.of(texts), np.arange(len(ids))
                for key in keys:
                    total = held.length + len(key)
                    s = np.where(total > 0, 2 * held.common(key) / np.maximum(total, 1), 0.0)
                    out += [(key, ids[i], texts[i], float(s[i])) for i in np.lexsort((rank, -s))[:k]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.float64()))], names=["key", "id", "name", "score"])

    packs = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("_packs"))
    packed = visits.join(packs, "block").groupBy("block", F.pmod(F.xxhash64("key"), F.col("_packs")).alias("_pack")).agg(F.collect_list("key").alias("keys"))
    return packed.join(blocks.select("block", "ids", "texts"), "block").select("keys", "ids", "texts").mapInArrow(run, "key string, id string, name string, score double")


def nearest(keys: DataFrame, names: DataFrame, k: int = 2) -> DataFrame:
    """keys {key}, names {id, name} -> {key, id, name, score, place}: for each distinct key the k names with the highest
    2 LCS / (sum of lengths), ties by id; exact. Equal names under several ids are several names. Null keys, ids and names are left out;
    a key has fewer rows where there are fewer names. Every id is to be there once."""
    keys = keys.select(F.col("key").cast("string").alias("key")).where("key is not null").distinct()
    names = names.select(F.col("id").cast("string").alias("id"), F.col("name").cast("string").alias("name")).where("id is not null and name is not null")
    keys, names = materialise(keys, "similar-keys"), materialise(names, "similar-all")
    sample = names.orderBy(F.xxhash64("name"), "name").limit(SAMPLE).select("name").toArrow().column(0).to_pylist()
    pivots = choose_pivots(sample)
    if not pivots:
        return keys.limit(0).select("key", F.lit("").alias("id"), F.lit("").alias("name"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("place"))
    blocks = materialise(_blocks(names, pivots), "similar-blocks")
    # a row of 2 * PIVOTS + 4 numbers a block: MOST_BLOCKS and the number of cells bound them
    known = blocks.select("block", "shortest", "longest", "n", "lo", "hi").toArrow()
    shape = {c: known.column(c).to_numpy() for c in ("block", "shortest", "longest", "n")} | {c: np.array(known.column(c).to_pylist()).reshape(-1, len(pivots)) for c in ("lo", "hi")}
    sent = keys.sparkSession.sparkContext.broadcast((pivots, shape))

    def visit(rest: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, shape = sent.value
            ends = Names.of(pivots)
            for batch in batches:
                who, where = [], []
                least = batch.column("least").to_pylist() if rest else None
                for i, key in enumerate(batch.column("key").to_pylist()):
                    bound = upper_bounds(len(key), ends.distance(key), shape)
                    order = np.lexsort((shape["block"], -bound))
                    first = max(FIRST_BLOCKS, int(np.searchsorted(np.cumsum(shape["n"][order]), k)) + 1)
                    chosen = order[first:][bound[order[first:]] >= least[i] - 1e-9] if rest else order[:first]
                    who += [key] * len(chosen)
                    where += shape["block"][chosen].tolist()
                if who:
                    yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(where, pa.int64())], names=["key", "block"])

        return run

    best = W.partitionBy("key").orderBy(F.col("score").desc(), "id")  # at most k rows a block that the key visits
    top = lambda df: df.withColumn("place", F.row_number().over(best).cast("long")).where(F.col("place") <= k)
    first = materialise(top(_scored(keys.mapInArrow(visit(False), "key string, block long"), blocks, k)), "similar-first")
    least = first.groupBy("key").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).otherwise(-1.0).alias("least"))
    more = _scored(materialise(least.mapInArrow(visit(True), "key string, block long"), "similar-visits"), blocks, k)
    return top(first.drop("place").unionByName(more))
