"""Suffix-array dedup: repeats of at least 100 bytes, from the LCP-interval tree of an enhanced suffix array.

The suffix array is made of the suffixes that can begin a repeat (see repeats.py): those of the
segments of anchors that occur in different surroundings. A stack scan over the LCP array walks
the interval tree bottom-up; an interval whose suffixes differ in the byte before them is a
maximal repeat, and all its suffixes are its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import pieces
from leadflow.llm.repeats import Kind, merged, packed, unpacked, with_spans

MIN_BYTES = 100


def enhanced_suffix_array(texts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of at least `least` bytes: text, start, length, LCP with the one before, byte before (-1: none)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    wide = int(lengths.max(initial=least))
    padded = np.zeros((len(texts), 2 * wide), np.uint8)
    for i, t in enumerate(texts):
        padded[i, : len(t)] = np.frombuffer(t, np.uint8)
    count = np.maximum(lengths - least + 1, 0)
    text = np.repeat(np.arange(len(texts)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    view = np.lib.stride_tricks.sliding_window_view(padded, wide, axis=1)
    suffixes = np.ascontiguousarray(view[text, start])
    order = np.argsort(suffixes.view(f"S{wide}")[:, 0], kind="stable")
    suffixes, text, start = suffixes[order], text[order], start[order]
    length = lengths[text] - start
    lcp = np.zeros(len(text), np.int64)
    if len(text) > 1:
        differ = suffixes[1:] != suffixes[:-1]
        same = np.where(differ.any(1), differ.argmax(1), wide)
        lcp[1:] = np.minimum(same, np.minimum(length[1:], length[:-1]))
    before = np.where(start > 0, padded[text, start - 1].astype(np.int64), -1)
    return text, start, length, lcp, before


def maximal_repeats(lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of each LCP interval of at least `least` whose suffixes differ to the left.

    Bottom-up over the interval tree: a stack holds the intervals that are still open, with the byte
    before their suffixes, or None once two differ. No byte before counts as one that differs."""
    high = np.flatnonzero(lcp >= least)
    if not len(high):
        return
    cuts = np.flatnonzero(np.diff(high) > 1) + 1
    values, lefts = lcp.tolist(), [None if b < 0 else b for b in before.tolist()]
    for run in np.split(high, cuts):
        first, last = int(run[0]) - 1, int(run[-1])
        stack: list[list] = []  # length, first suffix, byte before all of them
        leaf = lefts[first]
        for i in range(first + 1, last + 2):
            value = values[i] if i <= last else 0
            begin, left = i - 1, leaf
            while stack and stack[-1][0] > value:
                length, begin, own = stack.pop()
                left = own if own == left else None
                if left is None:
                    yield begin, i - 1, length
            if stack and stack[-1][0] == value:
                if stack[-1][2] != left:
                    stack[-1][2] = None
            elif value >= least:
                stack.append([value, begin, left])
            leaf = lefts[i] if i <= last else None


def repeat_groups(texts: list[bytes], least: int = MIN_BYTES) -> list[tuple[int, list[tuple[int, int]]]]:
    """All maximal repeats of a few texts: length, and every (text, start) where it occurs."""
    text, start, _, lcp, before = enhanced_suffix_array(texts, least)
    return [(n, [(int(text[i]), int(start[i])) for i in range(a, b + 1)]) for a, b, n in maximal_repeats(lcp, before, least)]


def later_occurrences(least: int):
    """A comparison for repeats.py: of each maximal repeat of the segments, every occurrence but the first goes."""

    def compare(docs: np.ndarray, los: np.ndarray, segs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        text, start, _, lcp, before = enhanced_suffix_array(segs, least)
        doc, at = docs[text], los[text] + start
        rank = np.empty(len(text), np.int64)
        rank[np.lexsort((at, doc))] = np.arange(len(text))
        gone: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        for a, b, n in maximal_repeats(lcp, before, least):
            own = rank[a : b + 1]
            i = np.arange(a, b + 1)[own != own.min()]
            gone.append(i)
            lengths.append(np.full(len(i), n))
        i = np.concatenate([np.empty(0, np.int64), *gone])
        return joined(doc[i], at[i], at[i] + np.concatenate([np.empty(0, np.int64), *lengths]))

    return compare


def joined(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document as their disjoint unions: nested repeats of one place come out once."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    turn = np.cumsum(np.append(True, doc[1:] != doc[:-1])) << 40  # keeps documents apart in one running maximum
    end = np.maximum.accumulate(turn + b)
    first = np.append(True, (turn + a)[1:] > end[:-1])
    last = np.append(first[1:], True)
    return doc[first], a[first], (end - turn)[last]


def dedup_bytes(docs: DataFrame, least: int = MIN_BYTES) -> DataFrame:
    """docs with `kept` (binary: the bytes that stay), `n_bytes`, `removed` (array of structs a, b; maximal).

    A byte goes if a string of `least` bytes that covers it also starts earlier: in a smaller doc_id,
    or earlier in its own document. Texts are whole; null counts as empty. A null doc_id comes before
    all others. Rows of equal doc_id and text are one document and get equal results; rows that share
    a doc_id alone are different documents, in the order of xxhash64 of their texts. All columns stay
    (those of the added names are replaced); an empty frame gives one. Bytes that stay may break a
    character: `kept` is binary.
    """
    rest = [c for c in docs.columns if c.lower() not in ("kept", "n_bytes", "removed")]
    # anchors of 32 bytes; segments hold up to least - 31 windows
    kind = Kind("bytes", least, min(32, max(8, least // 3)), keep_first=True)
    work = packed(docs, rest)
    own = work.columns
    marked = with_spans(work, kind, later_occurrences(least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most_bytes=16 << 20):
                kept, sizes, removed = [], [], []
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist()):
                    data = (text or "").encode()
                    gone = merged(spans, len(data))
                    edges = [0, *(x for s in gone for x in s), len(data)]
                    kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    sizes.append(len(data))
                    removed.append([{"a": a, "b": b} for a, b in gone])
                columns = [batch.column(c) for c in own]
                kind_of = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, kind_of)], names=[*own, "kept", "n_bytes", "removed"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields)
    out = marked.select(*own, "_spans").mapInArrow(run, f"{types}, kept binary, n_bytes long, removed array<struct<a:long,b:long>>")
    return out.select(*unpacked(rest), "kept", "n_bytes", "removed")


def digests(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = dedup_bytes(docs.select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


#: The same rows in DuckDB: every window of 100 bytes by its MD5 value. Texts that share a doc_id come in their own order.
DIGESTS_SQL = """
WITH t AS (SELECT dense_rank() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS o, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
d AS (SELECT o, any_value(x) AS x, CAST(any_value(length(x)) // 2 AS BIGINT) AS n FROM t GROUP BY o),
w AS (SELECT o, i, md5_number(substr(x, 2 * i + 1, 200)) AS g FROM (SELECT o, x, unnest(generate_series(0, n - 100)) AS i FROM d WHERE n >= 100)),
f AS (SELECT g, min((o << 32) + i) AS first FROM w GROUP BY g HAVING count(*) > 1),
gone AS (SELECT o, i, coalesce(i - lag(i) OVER (PARTITION BY o ORDER BY i) > 100, true) AS opens FROM w JOIN f USING (g) WHERE (o << 32) + i <> first),
s AS (SELECT o, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY o ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM gone) GROUP BY o, run),
k AS (SELECT s.o, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(substr(x, 2 * final + 1)) AS kept
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY o ORDER BY a), 0) AS before, max(b) OVER (PARTITION BY o) AS final FROM s) s JOIN d USING (o) GROUP BY s.o)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM t LEFT JOIN k USING (o)
"""
