"""Repeated windows of a corpus, by anchors: the part that suffix-array and substring dedup share.

A text is a sequence of units (bytes or words). Of each window of `size` units the k-gram with
the smallest hash is its anchor (winnowing), so equal windows have equal anchors at equal places.
Windows that follow one another share an anchor; the stretch they cover is a segment. One chain of
steps, each row handled once:

1. `anchor_rows`  one row for each anchor, with a hash of its segment's content; equal segments of a
   batch become one row that lists the other places, so a hot passage costs a row for each batch.
2. `decide`       rows sorted by anchor and segment stream by. Equal segments have equal windows: the
   smallest place among them stays, or none does. An anchor with different segments asks for the
   content of one of each.
3. `contents`     documents give what was asked of them.
4. `compare`      the different segments of one anchor are compared by content, by the caller's method
   (a suffix array, an automaton). Anchors with more segments than one task should hold are cut finer
   first: by the whole window, of which the anchor is a part, so that equal windows meet and no task
   holds them all; these stream by as in step 2.

A place is (doc_id, hash of the text, unit), in this order; a null doc_id comes first. Rows with equal
doc_id and text are one document; rows that share a doc_id alone are different documents.
Equality in step 2 and of whole windows is that of two 64-bit hashes of different families.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from leadflow.llm.common import NULL_ID, pieces

PLACE_BITS = 22
MOST_UNITS = 1 << 21
CHUNK_BYTES = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray, add: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit values (finaliser of MurmurHash3)."""
    x = x + np.uint64(add)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if not len(_powers) or len(_powers["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, b in (("up", int(BASE)), ("down", pow(int(BASE), -1, 1 << 64))):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


class Rolling:
    """Polynomial hashes of any stretch of a sequence of 64-bit units."""

    def __init__(self, units: np.ndarray):
        up, self.down = _power(len(units) + 1)
        self.sums = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray, add: int = 0) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start], add)


def byte_units(text: bytes) -> np.ndarray:
    return np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)


def word_units(text: bytes) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in text.split()], np.uint64)


def cut_bytes(text: bytes, start: int, end: int) -> bytes:
    return text[start:end]


@dataclass(frozen=True)
class Kind:
    """What the units are, how long a window is, and whether the first place of a repeated window stays."""

    name: str  # "bytes" or "words"
    size: int
    k: int
    keep_first: bool
    most_group: int = 4000  # segments of one anchor that are compared in one place

    @property
    def units(self) -> Callable[[bytes], np.ndarray]:
        return byte_units if self.name == "bytes" else word_units


def _sections(units: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of units of whole documents, or of parts of a long one that overlap by size - 1 units.

    Yields units, and for each part: its document, its first unit there, and its first unit here."""
    held: list[np.ndarray] = []
    where: list[tuple[int, int, int]] = []
    at = 0
    for d, u in enumerate(units):
        first = 0
        while len(u) - first >= size:
            part = u[first : first + MOST_UNITS]
            if at + len(part) > 2 * MOST_UNITS:
                yield np.concatenate(held), *map(np.array, zip(*where))
                held, where, at = [], [], 0
            held.append(part)
            where.append((d, first, at))
            at += len(part)
            if first + len(part) >= len(u):
                break
            first += len(part) - size + 1
    if held:
        yield np.concatenate(held), *map(np.array, zip(*where))


def segments(units: list[np.ndarray], size: int, k: int) -> Iterator[dict[str, np.ndarray]]:
    """Segments of each document: doc, lo (first window), n (windows), h (anchor's hash), s (segment's hash).

    Documents of fewer than `size` units have none."""
    w = size - k + 1
    for flat, doc, first, here in _sections(units, size):
        rolling = Rolling(flat)
        grams = len(flat) - k + 1
        i = np.arange(grams)
        full = rolling.of(i, i + k)
        low = np.uint64((1 << PLACE_BITS) - 1)
        key = (full & ~low) | i.astype(np.uint64)
        pad = -grams % w
        blocks = np.concatenate([key, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, w)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = np.diff(np.append(here, len(flat))) - size + 1  # windows of each part
        starts = np.arange(count.sum()) + np.repeat(here - np.cumsum(count) + count, count)
        part = np.repeat(np.arange(len(doc)), count)
        anchor = (np.minimum(right[starts], left[starts + w - 1]) & low).astype(np.int64)
        new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
        n = np.diff(np.append(new, len(starts)))
        lo, p = starts[new], part[new]
        content, digest = memoryview(flat).cast("B"), xxhash.xxh3_64_intdigest
        hashes = [digest(content[8 * x : 8 * y]) for x, y in zip(lo.tolist(), (lo + n + size - 1).tolist())]
        yield {"doc": doc[p], "lo": lo - here[p] + first[p], "n": n, "h": full[anchor[new]], "s": np.array(hashes, np.uint64)}


# The place of a segment in its document as one number: first window, and how many windows (128 at most).
def _pack(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (lo << 8 | n).astype(np.int64)


ROWS = StructType([StructField(n, LongType(), False) for n in ("h", "s", "_d", "_k", "p")] + [StructField("more", BinaryType(), True)])
ORDER = ["h", "s", "_d", "_k", "p"]


def _combined(h: np.ndarray, s: np.ndarray, d: np.ndarray, k: np.ndarray, p: np.ndarray) -> list[pa.Array]:
    """Rows of equal h and s as one: its smallest place, and in `more` the other places (d, k, p), if any."""
    order = np.lexsort((p, k, d, s, h))
    h, s, d, k, p = h[order], s[order], d[order], k[order], p[order]
    first = np.append(True, (np.diff(h) != 0) | (np.diff(s) != 0))[: len(h)]
    new = first | np.append(True, (np.diff(d) != 0) | (np.diff(k) != 0) | (np.diff(p) != 0))[: len(h)]  # repeated rows are one place
    h, s, d, k, p, first = h[new], s[new], d[new], k[new], p[new], first[new]
    rest = np.stack([d, k, p], 1)[~first].tobytes()
    counts = np.diff(np.append(np.flatnonzero(first), len(h))) - 1
    ends = 24 * np.cumsum(counts)
    more = pa.Array.from_buffers(pa.binary(), len(counts), [pa.py_buffer(np.packbits(counts > 0, bitorder="little").tobytes()), pa.py_buffer(np.append(0, ends).astype(np.int32).tobytes()), pa.py_buffer(rest)])
    return [*(pa.array(v[first].view(np.int64)) for v in (h, s, d, k, p)), more]


def anchor_rows(docs: DataFrame, kind: Kind) -> DataFrame:
    """docs {_d, _k, text} -> a row {h, s, _d, _k, p, more} for each different segment of a batch."""
    if kind.size - kind.k + 1 > 127:
        raise ValueError("a segment would have too many windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most_bytes=CHUNK_BYTES):
                d, k = (batch.column(c).to_numpy() for c in ("_d", "_k"))
                for x in segments([kind.units(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()], kind.size, kind.k):
                    yield pa.RecordBatch.from_arrays(_combined(x["h"], x["s"], d[x["doc"]], k[x["doc"]], _pack(x["lo"], x["n"])), names=ROWS.names)

    return docs.select("_d", "_k", "text").mapInArrow(run, ROWS)


class Repeats:
    """Rows of ROWS, sorted by ORDER, as they stream by: which places go. Holds one place between batches."""

    def __init__(self, keep_first: bool):
        self.keep_first = keep_first
        self.h = self.s = self.d = self.k = self.p = np.empty(0, np.int64)  # of the group that is open: its smallest place
        self.gone = False  # whether that place has been given out

    def feed(self, rows: dict[str, np.ndarray], more: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Where a group begins, and the places (d, k, p) that go."""
        kept = len(self.h)  # the open group's smallest place stands before the rows as if it were one of them
        h, s, d, k, p = (np.concatenate([old, rows[c]]) for old, c in ((self.h, "h"), (self.s, "s"), (self.d, "_d"), (self.k, "_k"), (self.p, "p")))
        begins = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))[: len(h)]
        start = np.flatnonzero(begins)
        group = np.cumsum(begins) - 1
        lead = start[group]
        other = (d != d[lead]) | (k != k[lead]) | (p != p[lead])
        some = np.append(np.zeros(kept, bool), np.asarray(more.is_valid()))
        listed = np.frombuffer(b"".join(more.drop_null().to_pylist()), np.int64).reshape(-1, 3)
        out = other
        if len(start) and not self.keep_first:
            several = np.zeros(len(start), bool)
            several[group[other | some]] = True
            out = other.copy()
            out[start] |= several
            out[:kept] &= not self.gone
            self.gone = bool(several[-1]) or (self.gone and kept == 1 and len(start) == 1)
        last = start[-1:]
        self.h, self.s, self.d, self.k, self.p = h[last], s[last], d[last], k[last], p[last]
        return begins[kept:], tuple(np.concatenate([v[out], listed[:, i]]) for i, v in enumerate((d, k, p)))


# What a document is told: a stretch that goes, or a segment whose content or windows are asked for.
SPAN, CONTENT, WINDOWS = 0, 1, 2
TOLD = StructType([StructField(n, LongType(), False) for n in ("_d", "_k", "what", "h", "a", "b")])


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy() for c in ORDER}


def decide(rows: DataFrame, kind: Kind, partitions: int) -> DataFrame:
    """Rows of ROWS -> what each document is told, as TOLD."""

    def told(d, k, what, h, a, b) -> pa.RecordBatch:
        n = len(d)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(v, np.int64), n)) for v in (d, k, what, h, a, b)], names=TOLD.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = Repeats(kind.keep_first)
        held = np.empty((0, 4), np.int64)  # h, d, k, p: one of each different segment of the anchor that is still open
        crowded = None  # the open anchor, if it has more of them than one task is to hold
        for batch in batches:
            rows = _columns(batch)
            begins, (d, k, p) = repeats.feed(rows, batch.column("more"))
            yield told(d, k, SPAN, 0, p >> 8, (p >> 8) + (p & 255) + kind.size - 1)
            held = np.concatenate([held, np.stack([rows[c] for c in ("h", "_d", "_k", "p")], 1)[begins]])
            if not len(held):
                continue
            edges = np.append(np.flatnonzero(np.append(True, held[1:, 0] != held[:-1, 0])), len(held))
            sizes = np.diff(edges)
            over = sizes > kind.most_group
            over[0] |= held[0, 0] == crowded
            asked = np.where(over, WINDOWS, np.where(sizes > 1, CONTENT, -1))
            if not over[-1]:
                asked[-1] = -1  # it may go on in the next batch
            each = np.repeat(asked, sizes)
            some = each >= 0
            yield told(held[some, 1], held[some, 2], each[some], held[some, 0], held[some, 3], 0)
            crowded = int(held[-1, 0]) if over[-1] else None
            held = held[len(held) if over[-1] else edges[-2] :]
        if len(held) > 1:
            yield told(held[:, 1], held[:, 2], CONTENT, held[:, 0], held[:, 3], 0)

    return rows.repartition(partitions, "h").sortWithinPartitions(*ORDER).mapInArrow(run, TOLD)


GIVEN = StructType([StructField("what", LongType(), False), *ROWS.fields, StructField("seg", BinaryType(), True)])


def contents(told: DataFrame, kind: Kind) -> DataFrame:
    """Documents {_d, _k, text, told (structs what, h, a, b)} -> the segments that are asked for {h, p, seg}, or all
    windows of them, with two hashes {h, s, p, more}, as GIVEN."""
    size = kind.size

    def rows_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        plain: list[list] = [[], [], [], [], []]
        fine: list[list[np.ndarray]] = [[], [], [], [], []]
        for d, k, text, asked in zip(*(batch.column(c).to_pylist() for c in ("_d", "_k", "text", "told"))):
            text = (text or "").encode()
            words = None if kind.name == "bytes" else text.split()
            rolling = None
            for x in asked:
                lo, n = x["a"] >> 8, x["a"] & 255
                if x["what"] == CONTENT:
                    seg = text[lo : lo + n + size - 1] if words is None else b" ".join(words[lo : lo + n + size - 1])
                    for out, v in zip(plain, (x["h"], d, k, x["a"], seg)):
                        out.append(v)
                else:
                    rolling = rolling or Rolling(kind.units(text))
                    i = np.arange(lo, lo + n)
                    content = [text[j : j + size] if words is None else b" ".join(words[j : j + size]) for j in i.tolist()]
                    digest = np.array([xxhash.xxh3_64_intdigest(c) for c in content], np.uint64)
                    for out, v in zip(fine, (rolling.of(i, i + size), digest, np.full(n, d), np.full(n, k), _pack(i, np.ones(n, np.int64)))):
                        out.append(v)
        if plain[0]:
            h, d, k, p = (pa.array(v, pa.int64()) for v in plain[:4])
            zero = pa.array(np.zeros(len(h), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), CONTENT)), h, zero, d, k, p, pa.nulls(len(h), pa.binary()), pa.array(plain[4], pa.binary())], names=GIVEN.names)
        if fine[0]:
            columns = _combined(*map(np.concatenate, fine))
            n = len(columns[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, WINDOWS)), *columns, pa.nulls(n, pa.binary())], names=GIVEN.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most_bytes=CHUNK_BYTES):
                yield from rows_of(batch)

    asked = F.filter("told", lambda x: x["what"] != SPAN)
    # with all columns, so that the shuffle of the documents is the one that the last join reads too
    return told.withColumn("told", asked).where(F.size("told") > 0).mapInArrow(run, GIVEN)


#: compare(documents, first units, segments) -> places of the documents in that list, first and last units of what goes.
Compare = Callable[[np.ndarray, np.ndarray, list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray]]


def compared(given: DataFrame, kind: Kind, compare: Compare, partitions: int, chunk: int = 800) -> DataFrame:
    """Rows of GIVEN -> {_d, _k, a, b}: stretches that go. Whole groups of one anchor are compared, several at a time."""

    def spans(d, k, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(v, np.int64)) for v in (d, k, a, b)], names=["_d", "_k", "a", "b"])

    def done(part: list[tuple]) -> pa.RecordBatch:
        keys = np.array([r[1:3] for r in part], np.int64)
        own, number = np.unique(keys, axis=0, return_inverse=True)  # documents in their order
        i, a, b = compare(number.ravel(), np.array([r[3] >> 8 for r in part]), [r[4] for r in part])
        i = np.asarray(i, np.int64)
        return spans(own[i, 0], own[i, 1], a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = Repeats(kind.keep_first)
        held: list[tuple] = []
        for batch in batches:
            n = int((batch.column("what").to_numpy() == CONTENT).sum())  # these come first
            new = zip(*(batch.column(c)[:n].to_pylist() for c in ("h", "_d", "_k", "p", "seg")))
            for r in new:
                if not held or r[:4] != held[-1][:4]:  # repeated rows are one document
                    held.append(r)
            while len(held) > chunk:
                cut = chunk
                while cut < len(held) and held[cut][0] == held[cut - 1][0]:
                    cut += 1
                if cut == len(held):
                    break  # the last group may go on in the next batch
                yield done(held[:cut])
                del held[:cut]
            if n < batch.num_rows:
                fine = batch.slice(n)
                _, (d, k, p) = repeats.feed(_columns(fine), fine.column("more"))
                yield spans(d, k, p >> 8, (p >> 8) + (p & 255) + kind.size - 1)
        if held:
            yield done(held)

    return given.repartition(partitions, "h").sortWithinPartitions("what", *ORDER).mapInArrow(run, "_d long, _k long, a long, b long")


def packed(docs: DataFrame, rest: list[str]) -> DataFrame:
    """doc_id and text as they are, and all other columns of `rest`, if any, as one struct `_rest`."""
    others = [F.col(f"`{c}`") for c in rest if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*others).alias("_rest")] if others else []))


def unpacked(rest: list[str]) -> list[Column]:
    return [F.col(c) if c in ("doc_id", "text") else F.col("_rest").getField(c).alias(c) for c in rest]


def with_spans(docs: DataFrame, kind: Kind, compare: Compare) -> DataFrame:
    """docs {doc_id, text, ...} -> its columns, `_d`, `_k` and `_spans` (array of structs a, b): what repeated windows cover."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.withColumns({"_d": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_k": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    told = decide(anchor_rows(named, kind), kind, partitions)
    lists = told.repartition(partitions, "_d", "_k").groupBy("_d", "_k").agg(F.collect_list(F.struct("what", "h", "a", "b")).alias("told"))
    # one join with the documents serves both what they are asked and what they are told
    base = named.repartition(partitions, "_d", "_k").join(lists.hint("shuffle_hash"), ["_d", "_k"], "left")
    more = compared(contents(base, kind), kind, compare, partitions)
    more = more.repartition(partitions, "_d", "_k").groupBy("_d", "_k").agg(F.collect_list(F.struct("a", "b")).alias("more"))
    nothing = F.array().cast("array<struct<a:long,b:long>>")
    own = F.transform(F.filter("told", lambda x: x["what"] == SPAN), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))
    both = F.concat(F.coalesce(own, nothing), F.coalesce("more", nothing))
    return base.join(more.hint("shuffle_hash"), ["_d", "_k"], "left").withColumn("_spans", both).drop("told", "more")


def merged(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Disjoint, sorted, maximal spans within a text of this many units."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        b = min(b, length)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
def merged(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Disjoint, sorted, maximal spans within a text of this many units."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
        b = min(b, length)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
