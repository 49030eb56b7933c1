"""Benchmark decontamination with DataFrame functions only.

Benchmark items become windows of n normalised words (an item with fewer words is one window), and
their hashes a bit table that goes to every task. A document is cut into words once; each word is
hashed once, hashes of windows are put together from those of their halves, and only windows that
the table knows leave the row. Their words are compared with the benchmark's before a hit counts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.llm.common import keyed, whole_rows
from leadflow.plans.session import materialise

# What is no word character, and what is one, before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Windows of one bit table, which is broadcast with the tasks: 64 bits each, 8 MB in all. A larger benchmark is
#: scanned for in several tables of this size, one after another.
TABLE_WINDOWS = 1 << 20
BITS_EACH = 64


def with_words(df: DataFrame, text: Column) -> DataFrame:
    """df with `w`, the words of a text in order and as written; a null text has none."""
    df = df.withColumn("w", F.split(F.coalesce(text, F.lit("")), BETWEEN + "+"))
    lead = (F.element_at("w", 1) == "").cast("int")
    tail = ((F.element_at("w", -1) == "") & (F.size("w") > 1)).cast("int")
    return df.withColumn("w", F.slice("w", lead + 1, F.size("w") - lead - tail))


def normal(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _with_window_hashes(df: DataFrame, sizes: list[int]) -> tuple[DataFrame, dict[int, str]]:
    """df {w, ...} with a column of hashes of the windows of each size, a window at each word; those at the end that
    are cut short have hashes too. Words that differ in the case of A-Z alone have equal hashes."""
    made = {1: "h1"}
    df = df.withColumn("h1", F.transform("w", lambda x: F.xxhash64(F.lower(x))))

    def need(size: int) -> str:
        nonlocal df
        if size not in made:
            left = 1 << (size - 1).bit_length() - 1  # the largest power of two below it
            a, b = need(left), need(size - left)
            df = df.withColumn(f"h{size}", F.zip_with(a, F.slice(b, F.lit(left + 1), F.size(b)), lambda x, y: F.xxhash64(x, y)))
            made[size] = f"h{size}"
        return made[size]

    named = {s: need(s) for s in sizes}
    return df, named


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """benchmark {item_id, text} -> distinct windows {gram, size, h, items}; items: the ids that hold it.

    An item without words has no window; a null item_id is kept as an item without a name and
    is not listed among the hits. Repeated items add nothing.
    """
    w = with_words(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"), normal(F.col("text"))).where("size(w) > 0")
    place = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))))
    grams = w.select("item_id", "w", place.alias("i")).select("item_id", F.slice("w", F.col("i"), n).alias("w"))
    grams = grams.groupBy("w").agg(F.collect_set("item_id").alias("items")).withColumn("size", F.size("w"))
    grams, made = _with_window_hashes(grams, list(range(1, n + 1)))
    h = F.element_at(F.array(*[F.col(made[s]) for s in range(1, n + 1)]), F.col("size"))
    return grams.select(F.array_join("w", " ").alias("gram"), "size", F.element_at(h, 1).alias("h"), "items")


def _bit_table(hashes: np.ndarray) -> tuple[Column, int]:
    """An array of longs with two bits set for each hash, and the number of its bits less one (a mask)."""
    mask = (1 << max(10, (BITS_EACH * len(hashes) - 1).bit_length())) - 1
    bits = np.zeros(mask + 1, np.uint8)
    bits[hashes & mask] = 1
    bits[(hashes >> 32) & mask] = 1
    longs = np.packbits(bits, bitorder="little").view("<i8")
    return F.split(F.lit(",".join(map(str, longs.tolist()))), ",").cast("array<bigint>"), mask


def _known(h: Column, table: Column, mask: int) -> Column:
    def bit(x: Column) -> Column:
        at = x.bitwiseAND(F.lit(mask)).cast("int")
        return F.getbit(F.get(table, F.shiftright(at, 6)), at.bitwiseAND(F.lit(63))) == 1

    return bit(h) & bit(F.shiftright(h, 32))


def _candidates(h: str, size: int, table: Column, mask: int) -> Column:
    """The windows of `w` whose hashes, in column h, the table knows: structs (at, size, gram)."""
    places = F.when(F.size("w") >= size, F.sequence(F.lit(0), F.size("w") - size)).otherwise(F.array().cast("array<int>"))
    known = F.filter(places, lambda i: _known(F.get(F.col(h), i), table, mask))
    return F.transform(known, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), normal(F.array_join(F.slice("w", i + 1, size), " ")).alias("gram")))


def scan(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """documents -> {doc_id, _d, _k, n_words, found}, a row each; found: structs (at, size, gram) of the windows that
    the tables of the benchmark's hashes know, few of which are not the benchmark's. Without a shuffle. It is written
    down, small as it is: a filter on `found` would else be pushed below, with all that `found` is made of."""
    rows = windows.select("size", "h").toArrow()  # numbers alone; the benchmark's words stay on the executors
    sizes, hashes = rows.column("size").to_numpy(), rows.column("h").to_numpy()
    base = with_words(keyed(docs), F.col("text")).drop("text")
    base, made = _with_window_hashes(base, sorted(set(sizes.tolist())))
    found = [F.array().cast("array<struct<at:int,size:int,gram:string>>")]
    for start in range(0, len(hashes), TABLE_WINDOWS):
        for size, h in made.items():
            part = slice(start, start + TABLE_WINDOWS)
            own = hashes[part][sizes[part] == size]
            if len(own):
                found.append(_candidates(h, size, *_bit_table(own)))
    return materialise(base.select("doc_id", "_d", "_k", F.size("w").cast("long").alias("n_words"), F.concat(*found).alias("found")), "scan")


def document_hits(scanned: DataFrame, windows: DataFrame) -> DataFrame:
    """One row per hit document: {_d, _k, spans, n_hit, n_words, items}; spans: disjoint sorted (at, end) in words.

    Here the words of each window are compared. Rows of equal key are one document. A document's windows
    are met in order: one that starts beyond the furthest end so far opens a new span."""
    asked = scanned.where(F.size("found") > 0).select("_d", "_k", "n_words", F.explode("found").alias("x"))
    asked = asked.select("_d", "_k", "n_words", "x.gram", "x.at", (F.col("x.at") + F.col("x.size")).alias("end"))
    hits = asked.join(windows.select("gram", "items"), "gram")
    along = W.partitionBy("_d", "_k").orderBy("at", "end")
    before = F.max("end").over(along.rowsBetween(W.unboundedPreceding, -1))
    hits = hits.withColumn("opens", F.coalesce(F.col("at") > before, F.lit(True)).cast("int")).withColumn("span", F.sum("opens").over(along.rowsBetween(W.unboundedPreceding, 0)))
    spans = hits.groupBy("_d", "_k", "span").agg(F.min("at").alias("at"), F.max("end").alias("end"), F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return spans.groupBy("_d", "_k").agg(
        F.array_sort(F.collect_list(F.struct("at", "end"))).alias("spans"),
        F.sum(F.col("end") - F.col("at")).cast("long").alias("n_hit"),
        F.max("n_words").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """documents, benchmark -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated; a row per document.

    Documents without words, null or empty, have zeros and the hash of an empty list. Repeated
    rows (same doc_id and text) each get the same result. An empty benchmark hits nothing.
    """
    windows = benchmark_windows(benchmark, n)
    scanned = scan(docs, windows)
    marked = document_hits(scanned, windows).select("_d", "_k", "n_hit", F.size("items").cast("long").alias("n_items"), F.array_join(F.array_sort("items"), ",").alias("items"))
    return scanned.select("doc_id", "_d", "_k", "n_words").join(marked, ["_d", "_k"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "spans", most_hit: float = 0.5) -> DataFrame:
    """docs without benchmark passages; same columns, whatever their names.

    mode "documents": a document with any hit goes. mode "spans": hit words go, each with the
    separators after it, and a document of which over most_hit of the words are hit goes whole.
    n_chars, where present, follows the new text. Clean documents pass unchanged, with their nulls;
    repeated rows get equal results; an empty benchmark changes nothing.
    """
    if mode not in ("spans", "documents"):
        raise ValueError(f"unknown mode {mode!r}")
    windows = benchmark_windows(benchmark, n)
    # written down: its size is known then, and a small one is broadcast instead of dealing out all texts
    marks = materialise(document_hits(scan(docs, windows), windows).select("_d", "_k", "spans", "n_hit", "n_words"), "hit-documents")
    every = whole_rows(docs)
    if mode == "documents":
        return every.join(marks, ["_d", "_k"], "left_anti").select("row.*")
    both = every.join(marks, ["_d", "_k"], "left").where(F.col("spans").isNull() | (F.col("n_hit") <= F.lit(most_hit) * F.col("n_words")))
    text = F.col("row.text")
    units = F.regexp_extract_all(text, F.lit(f"{WORD}+{BETWEEN}*"), F.lit(0))
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    ends = F.concat(F.transform("spans", lambda s: s["at"]), F.array(F.col("n_words").cast("int")))
    both = both.withColumn("units", F.when(F.col("spans").isNotNull(), units))
    kept = F.zip_with(starts, ends, lambda a, b: F.array_join(F.slice("units", a + 1, b - a), ""))
    clean = F.concat(F.regexp_extract(text, f"^{BETWEEN}*", 0), F.array_join(kept, ""))
    hit = F.col("spans").isNotNull()
    both = both.withColumn("clean", F.when(hit, clean).otherwise(text))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return both.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])


#: The same rows in DuckDB.
REPORT_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram, least(10, len(w)) AS size
  FROM (SELECT *, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM g) WHERE len(w) >= size),
x AS (SELECT p.r, p.i, p.size, g.item_id FROM p JOIN g ON g.size = p.size AND array_to_string(p.w[p.i:p.i + p.size - 1], ' ') = g.gram),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + size - 1)) AS k FROM (SELECT DISTINCT r, i, size FROM x)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM x) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
