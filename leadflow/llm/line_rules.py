"""Quality rules: Viterbi decoding of a linear-chain conditional random field marks every line as content or
boilerplate; a document stays if enough of its text is content and it passes two base rules.

The field is that of leadflow.llm.quality (features of a line and of its neighbours, weights of label changes,
fitted on a bounded sample of labelled documents); here the likeliest sequence of labels is decoded, not the
marginals. Lines of a batch of documents are decoded together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm import quality
from leadflow.llm.common import pieces, spare_name

WINDOW = 5
FEWEST_WORDS = 10
MOST_REPEATED_PERCENT = 20
LEAST_CONTENT = 0.5
SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def viterbi(score: np.ndarray, counts: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The likeliest labels (1: content) of the lines of several documents.

    score: log odds of content against boilerplate of each line by itself; counts: lines of each document;
    change[a, b]: weight of b after a. Of equally likely sequences, content wins at the later line first."""
    order, first = quality._grid(counts)
    lengths = counts[order]
    deep = int(lengths.max(initial=0))
    running = [int(np.searchsorted(-lengths, -t, "left")) for t in range(deep)]
    best = np.stack([np.zeros_like(score), score], 1)
    came = np.zeros((len(score), 2), np.int8)
    for t in range(1, deep):
        i = first[: running[t]] + t
        ways = best[i - 1][:, :, None] + change
        came[i] = ways[:, 1, :] >= ways[:, 0, :]
        best[i] += ways.max(1)
    label = np.zeros(len(score), np.int8)
    last = first + lengths - 1
    label[last] = best[last, 1] >= best[last, 0]
    for t in range(deep - 1, 0, -1):
        i = first[: running[t]] + t
        label[i - 1] = came[i, label[i]]
    return label


def _sums(marks: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of `marks` stand from each start to the next."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[np.append(starts[1:], len(marks))] - total[starts]


def _same(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that are equal where the columns (of small non-negative numbers) are, and how often each occurs."""
    out, n = columns[0].astype(np.int64), None
    for c in columns[1:]:
        _, out, n = np.unique(out * (int(c.max(initial=0)) + 1) + c, return_inverse=True, return_counts=True)
    return out, n


def base_counts(rows: list[bytes]) -> dict[str, np.ndarray]:
    """The five counts of each whole text (UTF-8). Words are runs of bytes that are not ASCII white space; windows are
    compared by the words themselves."""
    sizes = np.array([len(r) + 1 for r in rows], np.int64)
    starts = np.cumsum(sizes) - sizes
    buf = np.frombuffer(b"\n".join(rows) + b"\n", np.uint8)
    inside = ~SPACES[buf]
    out = {"word_chars": _sums(inside & ((buf & 0xC0) != 0x80), starts), "n_symbols": _sums(SYMBOLS[buf], starts)}
    number: dict[bytes, int] = {}
    words = [r.split() for r in rows]
    n_words = np.array([len(w) for w in words], np.int64)
    ids = np.array([number.setdefault(x, len(number)) for w in words for x in w], np.int64)
    doc = np.repeat(np.arange(len(rows)), n_words)
    out["n_words"] = n_words
    repeated = np.zeros(len(ids) + 1, np.int64)
    if len(ids) >= WINDOW:
        at = np.arange(len(ids) - WINDOW + 1)
        at = at[doc[at] == doc[at + WINDOW - 1]]
        pair, _ = _same(ids[:-1], ids[1:])
        four, _ = _same(pair[at], pair[at + 2])
        window, n = _same(four, ids[at + WINDOW - 1], doc[at])
        found = at[n[window] > 1] if len(at) else at
        np.add.at(repeated, found, 1)
        np.add.at(repeated, found + WINDOW, -1)
    covered = np.cumsum(repeated)[:-1] > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=len(rows)).astype(np.int64)
    again = []
    for r in rows:
        lines = [x for x in r.split(b"\n") if x.strip()]
        again.append(len(lines) - len(set(lines)))
    out["n_dup_lines"] = np.array(again, np.int64)
    return out


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < FEWEST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED_PERCENT * counts["n_words"])


def content_share(lines: quality.Lines, labels: np.ndarray) -> np.ndarray:
    """Share of each document's bytes that stand in lines labelled content; an empty line counts as one byte."""
    weight = np.maximum(lines.size, 1)
    starts = np.cumsum(lines.counts) - lines.counts
    return np.add.reduceat(labels * weight, starts) / np.add.reduceat(weight, starts)


def label_lines(model: quality.Model, lines: quality.Lines) -> np.ndarray:
    return viterbi(((lines.x - model.mean) / model.scale) @ model.weights, lines.counts, model.change)


def judge(docs: DataFrame, model: quality.Model, least: float = LEAST_CONTENT, text: str = "text") -> DataFrame:
    """docs with `judgement`, a struct of the five counts, base_failed, content_share, kept and content: the spans of
    content in lines, as {first, past} from 0. All columns stay (a column of that name is replaced).

    Whole texts are read, without a shuffle. A null or empty text has no word and one empty line, so it fails the base
    rules. Equal texts are judged alike; an empty frame gives one.
    """
    rest = [c for c in docs.columns if c.lower() != "judgement"]
    own = spare_name(rest, "text")
    frame = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text).cast("string"), F.lit("")).alias(own))
    kind = "struct<" + ",".join(f"{c}:bigint" for c in COUNTS) + ",base_failed:boolean,content_share:double,kept:boolean,content:array<struct<first:int,past:int>>>"
    spans = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, own):
                texts = batch.column(own).to_pylist()
                counts = base_counts([t.encode("utf-8", "replace") for t in texts])
                lines = quality.line_features(texts)
                labels = label_lines(model, lines)
                share, failed = content_share(lines, labels), base_failed(counts)
                runs = []
                for y in np.split(labels, np.cumsum(lines.counts)[:-1]):
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], y, [0]])))
                    runs.append([{"first": int(a), "past": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                made = [*[pa.array(counts[c]) for c in COUNTS], pa.array(failed), pa.array(share), pa.array(~failed & (share >= least)), pa.array(runs, spans)]
                told = pa.StructArray.from_arrays(made, names=[*COUNTS, "base_failed", "content_share", "kept", "content"])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], told], names=[*rest, "judgement"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{kept}judgement {kind}")


def keep_content(docs: DataFrame, labels: DataFrame, least: float = LEAST_CONTENT) -> DataFrame:
    """docs without those that the rules reject; their columns stay as they are."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    return judge(packed, quality.fit(docs, labels), least).where("judgement.kept").select("row.*")


def rule_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents, labels -> doc_id, the five counts, base_failed, kept; one row per row of documents."""
    out = judge(docs.select("doc_id", "text"), quality.fit(docs, labels))
    return out.select("doc_id", *[F.col(f"judgement.{c}").alias(c) for c in (*COUNTS, "base_failed", "kept")])
