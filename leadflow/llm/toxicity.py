"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two tokens counts common character subsequences of a fixed length and weighs each by
the span it takes in either string, so gaps and inserted characters cost weight but do not hide an
insult; it is normalised to 1 for equal tokens, and squared. The kernel of two sentences is the sum
over their pairs of tokens (runs of single letters count joined). The Nyström map takes a sentence to
its kernels with the landmarks, times the inverse root of their own kernel matrix, where a linear
machine is trained on sentences of labelled documents. A document is as toxic as its worst sentence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import give_back, lean, pieces, spare_name

LENGTH = 4  # of the subsequences
DECAY = 0.5  # weight of each character that a subsequence spans
WINDOW = 24  # longer tokens are seen through windows of this many characters, half overlapping
LANDMARKS = 24
LANDMARK_LENGTHS = range(4, 13)
POWER = 2  # of the normalised kernel: a power of a kernel is one, and makes less of faint likeness
MOST_TOKENS = 40  # of a sentence; a longer one counts as several
CACHE_TOKENS = 80_000
FIT_DOCS = 100  # whose sentences are mapped at a time in a fit
FIT_ROWS = 10_000  # sentences whose sums a Newton step takes at a time
SENTENCE_END = re.compile(r"[.!?\n]+(?=\s|$)|\n")
SPELLED = re.compile(r"(?<!\S)\S(?:[ \t]\S){3,}(?!\S)")
NOT_LETTERS = re.compile(r"[\W_]+")


def windows(token: str) -> list[str]:
    """The token without signs, or windows over all of a long one."""
    token = NOT_LETTERS.sub("", token)
    if len(token) <= WINDOW:
        return [token]
    half = WINDOW // 2
    return [token[i : i + WINDOW] for i in range(0, len(token) - half, half)]


def _codes(strings: list[str]) -> np.ndarray:
    """(strings, WINDOW) code points, 0 beyond the end."""
    out = np.zeros((len(strings), WINDOW), np.uint32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def subsequence_kernel(codes: np.ndarray, other: np.ndarray, p: int = LENGTH, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted kernel of each row of codes (0: matches nothing) with the string `other`, or with its own row of `other`."""
    m = other.shape[-1]
    # sums over earlier places of the other string, each place further away weighing decay less
    spread = np.triu(decay ** np.maximum(np.arange(m)[None, :] - np.arange(m)[:, None], 0)).astype(np.float32)
    inner = [np.ones((len(codes), m), np.float32)] + [np.zeros((len(codes), m), np.float32) for _ in range(p - 1)]
    total = np.zeros(len(codes), np.float32)
    for x in range(codes.shape[1]):
        c = codes[:, x : x + 1]
        if not c.any():
            for k in range(1, p):
                inner[k] *= np.float32(decay)
            continue
        match = ((c == other) & (c != 0)).astype(np.float32) * np.float32(decay * decay)
        for i in range(p - 1, -1, -1):
            # inner[i][:, j]: subsequences of length i in the strings before this character and before place j
            step = match * inner[i]
            if i == p - 1:
                total += step.sum(1)
            else:
                inner[i + 1] *= np.float32(decay)
                inner[i + 1][:, 1:] += (step @ spread)[:, :-1]
    return total


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """Kernel of each row of codes with itself; rows of like length are done together."""
    length = (codes != 0).sum(1)
    out = np.zeros(len(codes), np.float32)
    for low in range(0, WINDOW, 4):
        rows = np.flatnonzero((length > low) & (length <= low + 4))
        if len(rows):
            own = codes[rows, : low + 4]
            out[rows] = subsequence_kernel(own, own)
    return out


def common_length(codes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence with a string of at most 32 characters, by bit vectors.

    masks[c]: the places of character code c in that string."""
    v = np.full(len(codes), 0xFFFFFFFF, np.uint64)
    for x in range(codes.shape[1]):
        u = v & masks[codes[:, x]]
        v = ((v + u) | (v - u)) & np.uint64(0xFFFFFFFF)
    return 32 - np.bitwise_count(v).astype(np.int64)


class Landmarks:
    """Landmark strings, over an alphabet of the characters that occur in them."""

    def __init__(self, strings: list[str]):
        raw = _codes(strings)
        self.alphabet = np.unique(raw[raw != 0])
        self.rows = [self._letters(r[r != 0]) for r in raw]
        self.masks = np.zeros((len(strings), len(self.alphabet) + 1), np.uint64)
        for j, r in enumerate(self.rows):
            for i, c in enumerate(r.tolist()):
                self.masks[j, c] |= np.uint64(1 << i)
        self.own = np.array([max(float(subsequence_kernel(r[None, :], r)[0]), 1e-12) for r in self.rows])

    def _letters(self, raw: np.ndarray) -> np.ndarray:
        """1 and up for characters of the alphabet, 0 for all others."""
        at = np.minimum(np.searchsorted(self.alphabet, raw), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == raw, at + 1, 0).astype(np.int16)

    def similarities(self, strings: list[str]) -> np.ndarray:
        """Kernel of each string with each landmark: 1 where they are equal, less where the landmark is broken up or
        stands among other characters, 0 without a common subsequence."""
        out = np.zeros((len(strings), len(self.rows)), np.float32)
        raw = _codes(strings)
        codes = self._letters(raw)
        held = np.flatnonzero((codes != 0).sum(1) >= LENGTH) if len(strings) else np.empty(0, np.int64)
        codes = codes[held]
        near = [np.flatnonzero(common_length(codes, m) >= LENGTH) if len(held) else held for m in self.masks]
        some = np.unique(np.concatenate(near)) if near else held
        root = np.zeros(len(held), np.float32)
        root[some] = np.sqrt(np.maximum(self_kernel(raw[held[some]]), 1e-12))
        for j, row in enumerate(self.rows):
            if len(i := near[j]):
                wide = int((codes[i] != 0).nonzero()[1].max()) + 1
                out[held[i], j] = np.minimum(subsequence_kernel(codes[i, :wide], row) / (root[i] * self.own[j] ** 0.5), 1) ** POWER
        return out


def sentences(text: str) -> list[list[str]]:
    """Tokens of each sentence of a text, lower-cased; a run of single characters is one token more."""
    low = text.lower()
    spelled = [re.sub(r"\s", "", m) for m in SPELLED.findall(low)]
    out = [t for s in SENTENCE_END.split(low) if s and (t := s.split())]
    if spelled:
        out.append(spelled)
    return [s[i : i + MOST_TOKENS] for s in out for i in range(0, len(s), MOST_TOKENS)]


class TokenTable:
    """Similarity rows of distinct tokens, kept between batches up to a bound. Row 0: no match at all."""

    def __init__(self, marks: Landmarks, most: int = CACHE_TOKENS):
        self.marks, self.most = marks, most
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows = np.zeros((1, len(self.marks.rows)), np.float32)

    def learn(self, tokens: set[str]) -> None:
        if len(self.ids) > self.most:
            self.clear()
        new = sorted(tokens - self.ids.keys())
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            views = [windows(t) for t in part]
            sims = self.marks.similarities([w for v in views for w in v])
            counts = np.array([len(v) for v in views])
            best = np.maximum.reduceat(sims, np.cumsum(counts) - counts, axis=0)  # windows of a long token overlap
            some = best.any(1)
            places = np.where(some, len(self.rows) + np.cumsum(some) - 1, 0)
            self.rows = np.concatenate([self.rows, best[some]])
            self.ids.update(zip(part, places.tolist()))

    def pooled(self, docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel of every sentence with each landmark (a sum over its tokens), and the document of each sentence.

        Every document has one row at least (zeros where it has no tokens)."""
        self.learn({t for d in docs for s in d for t in s})
        get = self.ids.__getitem__
        flat: list[int] = []
        starts, owner = [], []
        for k, d in enumerate(docs):
            for s in d or [[]]:
                starts.append(len(flat))
                owner.append(k)
                flat.extend(map(get, s))
                flat.append(0)
        flat = np.array(flat)
        out = np.zeros((len(starts), self.rows.shape[1]), np.float32)
        hit = np.flatnonzero(flat)
        where = np.searchsorted(np.array(starts), hit, "right") - 1
        if len(hit):
            first = np.flatnonzero(np.diff(where, prepend=-1))
            out[where[first]] = np.add.reduceat(self.rows[flat[hit]], first, axis=0)
        return out, np.array(owner)


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # of similarities: the machine's weights, carried back through the Nyström map
    bias: float
    slope: float  # of the probability over the margin
    offset: float

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weights + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -40, 40)))


def choose_landmarks(docs: list[list[list[str]]], toxic: np.ndarray, count: int) -> list[str]:
    """Substrings that go with the label, each unlike those taken before (pivoted Cholesky of the kernel)."""
    seen = [Counter(), Counter()]
    for d, y in zip(docs, toxic):
        seen[int(y)].update({w for t in {t for s in d for t in s} for w in windows(t) if len(w) >= LENGTH})
    n = [max(1, int((toxic == y).sum())) for y in (0, 1)]
    cut = lambda w: {w[i : i + k] for k in LANDMARK_LENGTHS for i in range(len(w) - k + 1)}
    grams: Counter = Counter()
    for w, c in seen[1].items():
        if c / n[1] > 4 * (seen[0][w] + 0.2) / n[0]:
            for g in cut(w):
                grams[g] += c
    grams = Counter({g: c for g, c in grams.items() if c >= max(4, 0.01 * n[1])})
    clean: Counter = Counter()
    for w, c in seen[0].items():
        for g in cut(w):
            if g in grams:
                clean[g] += c
    value = {g: c / n[1] - 3 * clean[g] / n[0] for g, c in grams.items()}
    # of substrings that are seen equally often, the longest says most
    names = sorted((g for g in value if value[g] > 0), key=lambda g: (-value[g] * len(g) ** 0.5, g))[:400]
    if not names:
        return ["----"]
    gram = Landmarks(names).similarities(names).astype(np.float64)
    weight = np.sqrt([value[g] * len(g) ** 0.5 for g in names])
    left, basis, taken = np.ones(len(names)), np.zeros((len(names), 0)), []
    for _ in range(min(count, len(names))):
        k = int(np.argmax(left * weight))
        if left[k] < 0.05:
            break
        column = (gram[:, k] - basis @ basis[k]) / np.sqrt(left[k])
        basis = np.column_stack([basis, column])
        left = np.maximum(left - column**2, 0)
        left[[g in names[k] for g in names]] = 0  # its parts say the same
        taken.append(names[k])
    return taken


def _fit_machine(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps, whose sums run over blocks of rows."""
    sign = np.where(y, 1.0, -1.0)
    ridge = np.diag([1.0] * x.shape[1] + [1e-3])
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        gradient, hessian = ridge @ w, ridge.copy()
        for i in range(0, len(x), FIT_ROWS):
            x1, own = np.column_stack([x[i : i + FIT_ROWS], np.ones(len(x[i : i + FIT_ROWS]))]), sign[i : i + FIT_ROWS]
            short = 1 - own * (x1 @ w)
            on = short > 0
            x1 = x1[on]
            gradient -= 2 * cost * x1.T @ (own[on] * short[on])
            hessian += 2 * cost * x1.T @ x1
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _fit_line(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with Platt's softened targets."""
    n1, n0 = y.sum(), (~y).sum()
    target = np.where(y, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([margin, np.ones(len(margin))])
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(texts: Iterable[str], toxic: list[int], landmarks: int = LANDMARKS, rounds: int = 4) -> Model:
    """Fit on whole labelled texts. In a toxic text only its worst sentences count as toxic, chosen anew each round.

    With one class alone the model is a constant: that class's rate, softened.
    """
    y = np.array(toxic, bool)
    if not len(y) or y.all() or not y.any():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.05
        return Model(["----"], np.zeros(1, np.float32), 0.0, 1.0, float(np.log(rate / (1 - rate))))
    share: dict[str, str] = {}  # one object for each distinct token
    docs = [[[share.setdefault(t, t) for t in s] for s in sentences(x)] for x in texts]
    names = choose_landmarks(docs, y, landmarks)
    marks = Landmarks(names)
    tokens = TokenTable(marks, 10**9)
    tokens.learn(set(share))
    pooled, owner = zip(*(tokens.pooled(docs[i : i + FIT_DOCS]) for i in range(0, len(docs), FIT_DOCS)))
    pooled, owner = np.concatenate(pooled), np.concatenate([o + i * FIT_DOCS for i, o in enumerate(owner)])
    del tokens, docs, share
    gram = marks.similarities(names).astype(np.float64)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2 + 1e-2 * np.eye(len(names)))
    nystrom = vectors @ np.diag(np.maximum(values, 1e-6) ** -0.5)
    x = pooled @ nystrom
    said = y[owner]
    witness = said & (pooled.sum(1) > 0)
    for _ in range(rounds):
        used = witness | ~said
        w, b = _fit_machine(x[used], witness[used])
        f = x @ w + b
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, owner, f)
        witness = said & ((f >= best[owner] - 1e-9) | (f > 0.5))
    model = Model(names, (nystrom @ w).astype(np.float32), b, 1.0, 0.0)
    best = np.full(len(y), -np.inf)
    np.maximum.at(best, owner, model.margins(pooled))
    model.slope, model.offset = _fit_line(best, y)
    return model


def sample(docs: DataFrame, labels: DataFrame, each: int = 2000, longest: int = 20_000) -> list[tuple[str, int]]:
    """A bounded sample for training: up to `each` toxic and as many other labelled documents, of at most
    `longest` characters, chosen by a hash of their ids. At most 2 * each * longest characters reach the driver."""
    label = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", "text").where(F.length("text") <= longest)
    known = texts.select("doc_id").join(label, "doc_id").distinct()
    order = F.xxhash64("doc_id")
    ids = known.where("toxic = 1").orderBy(order, "doc_id").limit(each).unionByName(known.where("toxic = 0").orderBy(order, "doc_id").limit(each))
    # one text an id, so that rows that share one do not add up; ids are 2 * each at most, so they are broadcast
    rows = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    return [(r["text"], int(r["toxic"])) for r in sorted(rows, key=lambda r: r["doc_id"])]


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the probability that a text is toxic; all columns stay (a column of that name is replaced).

    Whole texts are read. A null or empty text gets the score of a sentence without tokens. Rows of
    equal text get equal scores. No shuffle; an empty frame gives one.
    """
    rest = [c for c in docs.columns if c.lower() != column.lower()]
    own = spare_name(rest, "text")
    frame = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text).cast("string"), F.lit("")).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenTable(Landmarks(model.landmarks))
        for whole in batches:
            for batch in pieces(whole, own, 1 << 20):
                texts = batch.column(own).to_pylist()
                pooled, owner = tokens.pooled([sentences(t) for t in texts])
                worst = np.full(len(texts), -np.inf)
                np.maximum.at(worst, owner, model.margins(pooled))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.probability(worst).astype(float))], names=[*rest, column])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema.fields[:-1])
    return frame.mapInArrow(lean(run), f"{kept}`{column}` double")


def held_out(parts: int, part: int):
    """Whether a row's doc_id falls into the fold that is never trained on (a null id does not)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, **bounds) -> Model:
    rows = sample(docs, labels.where(~held_out(parts, part)), **bounds)[::-1]
    toxic = [y for _, y in reversed(rows)]
    model = train((rows.pop()[0] for _ in toxic), toxic)  # the driver lets go of a text once it has its words
    give_back()
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """documents, labels -> doc_id, held_out, score, predicted; one row per row of documents."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without those that score `threshold` or more; the same columns."""
    own = spare_name(docs.columns, "toxicity")
    return score(docs, fit(docs, labels), column=own).where(F.col(own) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
