"""Near-duplicates by Jaccard similarity of word shingles, without a pair missed.

Candidates come from SimHash (simhash.links) and from a prefix index: two sets at SIMILAR or more share
one of the first n - ceil(SIMILAR n) + 1 shingles of each, in any one order of shingles. Every link is
decided by the sets themselves. Texts with equal sets are one node. In a first round each shingle links
its nodes to the smallest of them. In later rounds only nodes of different components meet: first one node in
16 with all others, then all that are left, so that a large group of near copies is one component before
it could make all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.llm import simhash
from leadflow.llm.common import NULL_ID, keyed, lean, may_be_among, pieces, small_batches
from leadflow.operators.components import connected_components
from leadflow.plans.session import materialise

#: Similarity 4/5, in whole numbers so that no rounding decides.
OVER, UNDER = 4, 5
#: Of so many documents one is looked at for how common shingles are. This orders the shingles: it changes times, not results.
SAMPLE, COMMON = 16, 200_000
#: Texts of about so many bytes are worked on at a time.
PIECE_BYTES = 1 << 20
#: Rounds in which nodes of different components meet: of so many nodes one meets all others. The last round leaves none out.
ROUNDS = (16, 1)
WORDS = 32
SKETCH = [f"s{i}" for i in range(WORDS)]


def shingle_set(text: str | None, k: int, seed: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(simhash.shingle_hashes(text, k, seed), np.uint64))


def name_of(shingles: np.ndarray) -> int:
    """A hash (as signed 64-bit) that names a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype(np.int64))


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """Parities of the set's counts in 2,048 cells: two sets differ in at least as many shingles as cells."""
    odd = np.bincount((shingles & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def prefix_of(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones before common ones; `common` is sorted."""
    n = len(shingles)
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        rank = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, rank))[: n - (OVER * n + UNDER - 1) // UNDER + 1]] if n else shingles


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of shingles have similarity 0.8 or more."""
    small, large = sorted((a, b), key=len)
    if not len(small):
        return len(large) == 0
    shared = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return UNDER * shared >= OVER * (len(a) + len(b) - shared)


def _marks(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """documents -> _d, _k, node, n (size of the set), fp (SimHash) and sketch; one row each, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most_bytes=PIECE_BYTES):
                hashes = [np.array(simhash.shingle_hashes(t, k, seed), np.uint64) for t in batch.column("text").to_pylist()]
                sets = [np.unique(h) for h in hashes]
                sketch = np.array([sketch_of(s) for s in sets]).reshape(-1, WORDS)
                columns = [pa.array([name_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(simhash.fingerprints_from(hashes))]
                yield pa.RecordBatch.from_arrays([batch.column("_d"), batch.column("_k"), *columns, *[pa.array(np.ascontiguousarray(c)) for c in sketch.T]], names=["_d", "_k", "node", "n", "fp", *SKETCH])

    return keyed(docs).select("_d", "_k", "text").mapInArrow(lean(run), "_d long, _k long, node long, n long, fp long, " + ", ".join(f"{s} long" for s in SKETCH))


def _common(docs: DataFrame, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of a sample and how many of its documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most_bytes=PIECE_BYTES):
                sets = [shingle_set(t, k, seed) for t in batch.column("text").to_pylist()]
                if sets:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    some = keyed(docs).where(F.pmod(F.xxhash64("_k"), F.lit(SAMPLE)) == 0).dropDuplicates(["_k"]).select("text")
    found = some.mapInArrow(lean(run), "h long").groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    h, n = found.column("h").to_numpy().view(np.uint64), found.column("count").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def _prefixes(docs: DataFrame, k: int, seed: int, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """documents -> h, node, n, at (place of h in the node's order); a partition gives a node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for batch in pieces(whole, most_bytes=PIECE_BYTES):
                rows = []
                for text in batch.column("text").to_pylist():
                    s = shingle_set(text, k, seed)
                    node = name_of(s)
                    if node in seen:
                        continue
                    seen.add(node)
                    first = prefix_of(s, common, counts).view(np.int64)
                    rows.append((first, np.full(len(first), node), np.full(len(first), len(s)), np.arange(len(first))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)], names=["h", "node", "n", "at"])

    return keyed(docs).select("text").mapInArrow(lean(run), "h long, node long, n long, at long")


def _alike_in_size(a: str, b: str) -> Column:
    return UNDER * F.least(a, b) >= OVER * F.greatest(a, b)


def _enough(one: tuple[str, str], other: tuple[str, str]) -> Column:
    """Whether two sets of these sizes, with a shingle in common at these places of their orders, can be similar if it is the
    first that they share: enough of both must be left. Of two similar sets the first shared shingle always passes."""
    (n, at), (m, to) = one, other
    rest = 1 + F.least(F.col(n) - F.col(at) - 1, F.col(m) - F.col(to) - 1)
    return _alike_in_size(n, m) & ((OVER + UNDER) * rest >= OVER * (F.col(n) + F.col(m)))


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, seed: int) -> DataFrame:
    """The pairs {u, v} of nodes whose sets are similar; sketches, which never rule out such a pair, spare most texts."""
    ends = [nodes.select(*[F.col(c).alias(f"{c}_{e}") for c in ("n", *SKETCH)], F.col("node").alias(e)) for e in ("u", "v")]
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{s}_u").bitwiseXOR(F.col(f"{s}_v"))) for s in SKETCH])
    # similar sets of n and m shingles differ in (n + m) / 9 at most
    may = _alike_in_size("n_u", "n_v") & ((UNDER + OVER) * apart <= (UNDER - OVER) * (F.col("n_u") + F.col("n_v")))
    left = materialise(pairs.join(ends[0], "u").join(ends[1], "v").where(may).select("u", "v"), "similar-pairs")
    if left.isEmpty():
        return left
    asked = left.select(F.col("u").alias("node")).unionByName(left.select(F.col("v").alias("node"))).distinct()
    asked = materialise(nodes.join(asked, "node").select("node", "_d", "_k"), "similar-asked")
    key = ["_d", "_k"]
    some = may_be_among(keyed(docs), asked, key).where("_maybe").select("text", *key)
    texts = some.join(asked, key).dropDuplicates(key).select("node", "text")  # repeated rows of a document are in one place by then

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most_bytes=PIECE_BYTES):
                sets = [shingle_set(t, k, seed).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "set"])

    sets = materialise(texts.mapInArrow(lean(sets_of), "node long, set binary"), "similar-sets")  # each text is read once, however many pairs it has
    both = left.join(sets.select(F.col("node").alias("u"), F.col("set").alias("own")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("other")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, "own")):
            good = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(batch.column("own").to_pylist(), batch.column("other").to_pylist())]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return materialise(both.select("u", "v", "own", "other").mapInArrow(lean(run), "u long, v long"), "similar-links")


def _grown(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: a known component counts as its links to its smallest node."""
    return found if links.isEmpty() else connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))


def _components(nodes: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnRenamed("node", "x")
    return nodes.select("node").join(found, F.col("node") == F.col("x"), "left").select("node", F.coalesce("component", "node").alias("c"))


def _met(shared: DataFrame, found: DataFrame, one_in: int) -> DataFrame:
    """Pairs {u, v} of nodes of different components that share a shingle and can be similar, where one of the two is among
    every one_in-th node. Of two such nodes one at least is outside the largest component that has the shingle, so the nodes
    of that component do not meet each other."""
    found = found.withColumnsRenamed({"node": "x", "component": "y"})
    found = found.join(found.groupBy("y").agg(F.count("*").alias("many")), "y")
    now = shared.select("h", "node", "n", "at").join(found, F.col("node") == F.col("x"), "left").withColumn("own", F.struct(F.coalesce("many", F.lit(1)).alias("many"), F.coalesce("y", "node").alias("c")))
    same = W.partitionBy("h")
    now = now.select("h", "node", "n", "at", "own.c", F.min("own").over(same).alias("low"), F.max("own").over(same).alias("top")).where("low < top")
    now = materialise(now.select("h", "node", "n", "at", "c", (F.col("c") != F.col("top.c")).alias("outside")), "similar-mixed")
    a, b = (now.select("h", *[F.col(x).alias(f"{x}_{e}") for x in ("node", "n", "at", "c", "outside")]) for e in ("u", "v"))
    among = lambda e: F.pmod(F.xxhash64(f"node_{e}"), F.lit(one_in)) == 0
    if one_in > 1:
        b = b.where(among("v"))  # the few; those outside are looked up among them
    apart = (F.col("c_u") < F.col("c_v")) | ((F.col("c_u") != F.col("c_v")) & ~F.col("outside_v")) if one_in == 1 else F.col("c_u") != F.col("c_v")
    met = a.where("outside_u").join(b, "h").where(apart & _enough(("n_u", "at_u"), ("n_v", "at_v")))
    return met.select(F.least("node_u", "node_v").alias("u"), F.greatest("node_u", "node_v").alias("v")).distinct()


def grouped(docs: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """documents -> {doc_id, _d, _k, first}; first: the smallest {_d, _k} of the group of near-duplicates.

    All that Python does is written before this returns, in small batches: a pair brings two whole sets."""
    with small_batches(docs.sparkSession):
        return _grouped(docs, k, seed)


def _grouped(docs: DataFrame, k: int, seed: int) -> DataFrame:
    marks = materialise(_marks(docs, k, seed), "similar")
    nodes = marks.groupBy("node").agg(F.min(F.struct("_d", "_k")).alias("m"), *[F.first(c).alias(c) for c in ("n", "fp", *SKETCH)])
    nodes = materialise(nodes.select("node", "m._d", "m._k", "n", "fp", *SKETCH), "similar-nodes")

    tokens = _prefixes(docs, k, seed, *_common(docs, k, seed)).repartition("h").dropDuplicates(["h", "node"])
    same = W.partitionBy("h")  # a window and not a join, which would make and deal the tokens twice; its buffer spills
    first = F.min(F.struct("node", "n", "at")).over(same)
    shared = tokens.select("*", first.alias("hub"), F.max("node").over(same).alias("far")).where("hub.node < far")
    shared = shared.select("h", "node", "n", "at", F.col("hub.node").alias("hub"), F.col("hub.n").alias("n_hub"), F.col("hub.at").alias("at_hub"))
    shared = materialise(shared, "similar-shared")

    prints = nodes.groupBy("fp").agg(F.min("node").alias("rep"))
    by_print = simhash.links(prints).select("u", "v").unionByName(nodes.join(prints, "fp").where("node != rep").select(F.col("rep").alias("u"), F.col("node").alias("v")))
    by_hub = shared.where((F.col("node") != F.col("hub")) & _enough(("n", "at"), ("n_hub", "at_hub"))).select(F.col("hub").alias("u"), F.col("node").alias("v"))
    pairs = by_print.unionByName(by_hub).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    found = connected_components(_verified(pairs, nodes, docs, k, seed))

    for one_in in ROUNDS:
        found = _grown(found, _verified(_met(shared, found, one_in), nodes, docs, k, seed))

    component = _components(nodes, found)
    least = nodes.join(component, "node").groupBy("c").agg(F.min(F.struct("_d", "_k")).alias("first"))
    named = component.join(least, "c").select("node", "first")
    return marks.join(named, "node").select(F.when(F.col("_d") != NULL_ID, F.col("_d")).alias("doc_id"), "_d", "_k", "first")


def near_duplicates(docs: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """documents -> doc_id, component_id; one row per row of documents.

    component_id is the smallest doc_id reachable over links between texts whose sets of k-word shingles
    (of lower-cased words; a shorter text is one shingle) have Jaccard similarity 0.8 or more. Null and
    empty texts have equal, empty sets. Null ids, rows that share an id and repeated rows are treated as in
    simhash.near_duplicates.
    """
    return grouped(docs, k, seed).select("doc_id", F.when(F.col("first._d") != NULL_ID, F.col("first._d")).alias("component_id"))


def keep_first(docs: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """docs reduced to the first document of each group of near-duplicates, as simhash.keep_first does."""
    return simhash.first_of(docs, grouped(docs, k, seed))
