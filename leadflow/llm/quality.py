"""Quality: a linear-chain conditional random field labels every line good or bad.

A line is described by its own shape and that of its neighbours. The document's quality is the
mean of the forward-backward marginals of its lines, weighted by length, put on the scale of the
labels by a logistic curve. Lines of a batch of documents are processed together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.llm.common import pieces, spare_name


def _class_tables() -> np.ndarray:
    t = np.zeros((7, 256), np.uint8)
    t[0, 65:91] = 1  # capitals
    t[1, 97:123] = 1  # small letters
    t[2, 48:58] = 1  # digits
    t[3, [32, 9, 10, 13]] = 1  # white space
    t[4, [ord(c) for c in ".,;:?'\"()-"]] = 1  # marks of ordinary prose
    t[5, [ord(c) for c in "!#$%&*+/<=>@[\\]^_`{|}~"]] = 1  # other signs
    t[6, 128:] = 1  # beyond ASCII
    return t


CLASSES = _class_tables()
OWN = ["empty", "log_bytes", "capitals", "digits", "space", "prose_marks", "signs", "other", "word_bytes", "repeated_words", "repeated_line", "ends_sentence", "sign_words", "capital_words"]


@dataclass
class Lines:
    """Lines of several documents: features (own, previous, next, bias), bytes, and lines per document."""

    x: np.ndarray
    size: np.ndarray
    counts: np.ndarray


def line_features(texts: list[str | None]) -> Lines:
    """Features of every line of whole texts; a text without characters is one empty line."""
    rows = [(t or "").encode("utf-8", "replace") for t in texts]
    counts = np.array([r.count(b"\n") + 1 for r in rows])
    joined = b"\n".join(rows) + b"\n"
    buf = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    sums = np.stack([np.add.reduceat(t[buf], starts, dtype=np.int32) for t in CLASSES]).astype(np.float64)
    sums[3] -= 1  # the line's end
    lines = joined.split(b"\n")[:-1]
    doc = np.repeat(np.arange(len(rows)), counts)
    words = np.zeros(len(lines))
    distinct, sign_end, shout = np.zeros(len(lines)), np.zeros(len(lines)), np.zeros(len(lines))
    signs, loud = frozenset(b"!#$%&*+/<=>@^_`{|}~"), frozenset(range(65, 91))
    for i, line in enumerate(lines):
        w = line.split()
        if w:
            words[i], distinct[i] = len(w), len(set(w))
            sign_end[i] = sum([x[-1] in signs for x in w])
            shout[i] = sum([x[0] in loud and x[len(x) >> 1] in loud for x in w if len(x) > 1])
    seen: dict[tuple[int, bytes], int] = {}
    again = np.zeros(len(lines))
    for i, (d, line) in enumerate(zip(doc.tolist(), lines)):
        if line:
            key = (d, line)
            if key in seen:
                again[i] = again[seen[key]] = 1
            else:
                seen[key] = i
    n, w = np.maximum(size, 1), np.maximum(words, 1)
    last = buf[np.maximum(ends - 1, 0)]
    own = np.stack([
        size == 0, np.log1p(size) / 5, sums[0] / n, sums[2] / n, sums[3] / n, sums[4] / n, sums[5] / n, sums[6] / n,
        np.minimum(size / w, 40) / 10, 1 - distinct / w, again, (size > 0) & np.isin(last, np.frombuffer(b".!?", np.uint8)), sign_end / w, shout / w,
    ], axis=1).astype(np.float64)
    first, final = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    at = np.cumsum(counts)
    first[at - counts] = True
    final[at - 1] = True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[final] = 0, 0
    x = np.column_stack([own, before, after, first, final, np.ones(len(lines))])
    return Lines(x, size.astype(np.float64), counts)


def _grid(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents from the most lines down, and their first lines: at step t the first k of them are still running."""
    order = np.argsort(-counts, kind="stable")
    return order, (np.cumsum(counts) - counts)[order]


def forward_backward(score: np.ndarray, counts: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginal of "good" for each line, expected label changes (2 x 2), and the sum of log partition values.

    score: log odds of good against bad of each line by itself; change[a, b]: weight of b after a."""
    order, first = _grid(counts)
    lengths = counts[order]
    deep = int(lengths.max(initial=0))
    running = [int(np.searchsorted(-lengths, -t, "left")) for t in range(deep)]
    logits = np.stack([np.zeros_like(score), score], 1)
    alpha, beta = np.zeros_like(logits), np.zeros_like(logits)
    alpha[first] = logits[first]
    for t in range(1, deep):
        i = first[: running[t]] + t
        a = alpha[i - 1][:, :, None] + change
        top = a.max(1)
        alpha[i] = logits[i] + top + np.log(np.exp(a - top[:, None, :]).sum(1))
    for t in range(deep - 1, 0, -1):
        i = first[: running[t]] + t
        b = change + (logits[i] + beta[i])[:, None, :]
        top = b.max(2)
        beta[i - 1] = top + np.log(np.exp(b - top[:, :, None]).sum(2))
    joint = alpha + beta
    last = first + lengths - 1
    top = alpha[last].max(1)
    log_z = np.zeros(len(counts))
    log_z[order] = top + np.log(np.exp(alpha[last] - top[:, None]).sum(1))
    each = np.repeat(log_z, counts)
    good = np.exp(np.minimum(joint[:, 1] - each, 0))
    expected = np.zeros((2, 2))
    follows = np.ones(len(score), bool)
    follows[first] = False
    i = np.flatnonzero(follows)
    if len(i):
        pair = alpha[i - 1][:, :, None] + change + (logits[i] + beta[i])[:, None, :] - each[i][:, None, None]
        expected = np.exp(np.minimum(pair, 0)).sum(0)
    return good, expected, float(log_z.sum())


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    change: np.ndarray
    slope: float
    offset: float

    def marginals(self, lines: Lines) -> np.ndarray:
        return forward_backward(((lines.x - self.mean) / self.scale) @ self.weights, lines.counts, self.change)[0]

    def quality(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean marginal of each document; an empty line counts as one byte."""
        good, weight = self.marginals(lines), np.maximum(lines.size, 1)
        starts = np.cumsum(lines.counts) - lines.counts
        return np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)

    def score(self, lines: Lines) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _log_odds(self.quality(lines)) + self.offset, -40, 40)))


def _log_odds(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def _constant(features: int, rate: float) -> Model:
    return Model(np.zeros(features), np.ones(features), np.zeros(features), np.zeros((2, 2)), 0.0, float(np.log(rate / (1 - rate))))


def line_labels(good: np.ndarray, size: np.ndarray, counts: np.ndarray, p: np.ndarray, sure: float = 0.6) -> np.ndarray:
    """Labels of lines: their document's, but for lines that the probabilities p ("good") deny.

    Of a document the surest of those change, while they take less than half of its bytes: so a document stays mostly what it is labelled."""
    doc = np.repeat(np.arange(len(counts)), counts)
    y = good[doc].astype(float)
    against = np.where(y == 1, 1 - p, p)
    order = np.lexsort((-against, doc))
    weight = np.maximum(size, 1)
    total = np.cumsum(weight[order])
    starts = np.cumsum(counts) - counts
    before = np.concatenate([[0.0], total])[starts]
    whole = np.add.reduceat(weight, starts)
    change = order[(against[order] > sure) & (2 * (total - before[doc]) < whole[doc])]
    y[change] = 1 - y[change]
    return y


def _climb(x: np.ndarray, y: np.ndarray, counts: np.ndarray, w: np.ndarray, change: np.ndarray, ridge: float, rounds: int, chained: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent (Adam) on the penalised likelihood of the label sequences; without `chained`, lines stand alone."""
    starts = np.cumsum(counts) - counts
    follows = np.ones(len(y), bool)
    follows[starts] = False
    i = np.flatnonzero(follows)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i - 1].astype(int), y[i].astype(int)), 1)
    width = len(w)
    m = v = np.zeros(width + 4)
    for step in range(1, rounds + 1):
        if chained:
            p, expected, _ = forward_backward(x @ w, counts, change)
        else:
            p, expected = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40))), seen
        g = np.concatenate([x.T @ (y - p) - ridge * w, (seen - expected - ridge * change).ravel()]) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w = w + move[:width]
        change = np.clip(change + move[width:].reshape(2, 2), -3, 3)
    return w, change


def train(lines: Lines, good: np.ndarray, ridge: float = 1.0, rounds: int = 200) -> Model:
    """Fit on lines of labelled documents. Lines have no labels of their own: they begin with their document's, and a
    first machine that sees each line alone, then the chain, tell which lines of a document differ from it
    (line_labels). So the chain sees changes of label and learns how likely they are.

    One class alone gives a constant score, softened.
    """
    width = lines.x.shape[1]
    if not len(good) or good.all() or not good.any():
        return _constant(width, (good.sum() + 0.5) / (len(good) + 1) if len(good) else 0.5)
    mean, scale = lines.x.mean(0), lines.x.std(0)
    mean[-1], scale[scale < 1e-9] = 0, 1
    x = (lines.x - mean) / scale
    y = np.repeat(good.astype(float), lines.counts)
    w, change = _climb(x, y, lines.counts, np.zeros(width), np.zeros((2, 2)), ridge, rounds // 2, chained=False)
    y = line_labels(good, lines.size, lines.counts, 1 / (1 + np.exp(-np.clip(x @ w, -40, 40))))
    w, change = _climb(x, y, lines.counts, w, change, ridge, rounds // 2)
    y = line_labels(good, lines.size, lines.counts, forward_backward(x @ w, lines.counts, change)[0])
    w, change = _climb(x, y, lines.counts, w, change, ridge, rounds)
    model = Model(mean, scale, w, change, 1.0, 0.0)
    q = np.column_stack([_log_odds(model.quality(lines)), np.ones(len(good))])
    curve, target = np.array([1.0, 0.0]), np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(q @ curve, -40, 40)))
        curve = curve - np.clip(np.linalg.solve((q * (p * (1 - p) + 1e-9)[:, None]).T @ q + 1e-3 * np.eye(2), q.T @ (p - target) + 1e-3 * curve), -2, 2)
    model.slope, model.offset = float(curve[0]), float(curve[1])
    return model


def held_out(parts: int = 3, part: int = 1):
    """Whether a row's doc_id falls into the fold that is never trained on (a null id does not)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, each: int = 2500, longest: int = 50_000, lines: int = 400_000) -> Model:
    """Train on a bounded sample outside the held-out fold: up to `each` good and as many bad documents of at most
    `longest` characters, chosen by a hash of their ids, and of these in that order as many as have `lines` lines together.
    Line features are made on the executors."""
    label = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", "text").where(F.length("text") <= longest)
    known = texts.select("doc_id").join(label, "doc_id").distinct()
    order = F.xxhash64("doc_id")
    ids = known.where("quality = 1").orderBy(order, "doc_id").limit(each).unionByName(known.where("quality = 0").orderBy(order, "doc_id").limit(each))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                lines = line_features(batch.column("text").to_pylist())
                cuts = np.cumsum(lines.counts)[:-1]
                parts = [pa.array([a.astype(np.float32).tobytes() for a in np.split(v, cuts)], pa.binary()) for v in (lines.x, lines.size)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality").cast(pa.int32()), *parts], names=["doc_id", "quality", "x", "size"])

    # one text an id, so that rows that share one do not add up; ids are 2 * each at most, so they are broadcast
    chosen = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text"))
    sofar = F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).over(W.orderBy(order, "doc_id"))  # 2 * each rows at most
    chosen = chosen.withColumn("sofar", sofar).where(F.col("sofar") <= lines).select("doc_id", "quality", "text")
    rows = chosen.mapInArrow(features, "doc_id long, quality int, x binary, size binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return _constant(3 * len(OWN) + 3, 0.5)
    size = [np.frombuffer(r["size"], np.float32).astype(np.float64) for r in rows]
    x = np.concatenate([np.frombuffer(r["x"], np.float32).astype(np.float64).reshape(len(s), -1) for r, s in zip(rows, size)])
    return train(Lines(x, np.concatenate(size), np.array([len(s) for s in size])), np.array([r["quality"] == 1 for r in rows]))


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the probability that a text is good; all columns stay (a column of that name is replaced).

    Whole texts are read, without a shuffle. A null or empty text is one empty line. Equal texts get
    equal scores; an empty frame gives one.
    """
    rest = [c for c in docs.columns if c.lower() != column.lower()]
    own = spare_name(rest, "text")
    frame = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text).cast("string"), F.lit("")).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, own):
                lines = line_features(batch.column(own).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.score(lines))], names=[*rest, column])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{kept}`{column}` double")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted; one row per row of documents."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
