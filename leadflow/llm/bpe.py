"""Byte-level BPE: merges by a priority queue over a doubly linked symbol list.

The vocabulary file is a parameter. The driver reads it once and broadcasts its bytes (their
size is checked); each Python worker parses them once and keeps a bounded cache of pieces.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import spare_name

# The published pattern that cuts text into pieces for this family of vocabularies.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MOST_VOCABULARY_BYTES = 64 << 20
CACHE_ENTRIES = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else 256 and up in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceCache(dict):
    """piece -> its ids; a missing piece is merged and kept. Cleared when full, so memory is bounded."""

    def __init__(self, merge, most: int):
        super().__init__()
        self.merge, self.most = merge, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        self[piece] = ids = self.merge(piece.encode())
        return ids


class ByteBPE:
    """Encoder and decoder of one vocabulary file in the public tokenizer.json format."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letter = byte_alphabet()
        value = {c: b for b, c in letter.items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.strings: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.strings[i] = bytes(value[c] for c in token)
        for token, i in self.specials.items():
            self.strings[i] = token.encode()
        self.first = [vocab[letter[b]] for b in range(256)]
        self.size = size
        # left id * size + right id -> rank, the place in the list of merges; merged[rank] is what the two become
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] * size + vocab[b], rank)
            self.merged.append(vocab[a + b])
        self.split = regex.compile(PIECE_PATTERN).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.cache = PieceCache(self.merge, CACHE_ENTRIES)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: always the merge of lowest rank, leftmost first, until none is left."""
        ids = list(map(self.first.__getitem__, piece))
        n, size, rank_of, merged = len(ids), self.size, self.ranks.get, self.merged
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        # A queue entry holds a rank and, in the low bits, the place of the left symbol; live[place] is
        # the one entry of that place that still counts.
        shift = n.bit_length()
        places = (1 << shift) - 1
        live = [-1 if (r := rank_of(a * size + b)) is None else r << shift | i for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        live.append(-1)
        queue = [x for x in live if x >= 0]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & places
            if live[i] != entry:
                continue  # stale: one of the two symbols has gone or grown meanwhile
            j = after[i]
            ids[i] = new = merged[entry >> shift]
            ids[j] = live[j] = live[i] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new * size + ids[k])) is not None:
                    live[i] = entry = r << shift | i
                    heappush(queue, entry)
            h = before[i]
            if h >= 0:
                if (r := rank_of(ids[h] * size + new)) is None:
                    live[h] = -1
                else:
                    live[h] = entry = r << shift | h
                    heappush(queue, entry)
        return tuple([x for x in ids if x >= 0])

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. Special tokens written out in it become their ids, as the tokenizers library has it."""
        if self.special is None or not self.special.search(text):
            return np.fromiter(chain.from_iterable(map(self.cache.__getitem__, self.split(text))), np.int32)
        parts = []
        for part in self.special.split(text):
            if part in self.specials:
                parts.append(np.array([self.specials[part]], np.int32))
            elif part:
                parts.append(np.fromiter(chain.from_iterable(map(self.cache.__getitem__, self.split(part))), np.int32))
        return np.concatenate(parts) if parts else np.empty(0, np.int32)

    def decode(self, ids) -> str:
        """The vocabulary strings of ids, concatenated; broken UTF-8 is replaced."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def load(raw: bytes) -> ByteBPE:
    """The vocabulary of these bytes, parsed once in each process."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        _loaded[key] = ByteBPE(raw)
    return _loaded[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(raw) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary of over {MOST_VOCABULARY_BYTES} bytes: not broadcast")
    return raw


def encode_documents(docs: DataFrame, vocabulary: str, text: str = "text", decode: bool = True) -> DataFrame:
    """docs with `ids` (array<int>) and, if asked for, `decoded` (string) added; one row each, no shuffle.

    docs: any frame with the text column; all its columns are kept, and columns of the added
    names are replaced. A null text counts as empty: no ids, decoded "". Texts of any length are
    encoded whole; a piece is never cut. Equal texts give equal results. An empty frame gives one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    rest = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    own = spare_name(rest, "text")
    frame = docs.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col(text).cast("string"), F.lit("")).alias(own))
    added = "ids array<int>" + ", decoded string" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                ids = [bpe.encode(t) for t in batch.column(own).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate([np.empty(0, np.int32), *ids])
                out = [*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                names = [*rest, "ids"]
                if decode:
                    out.append(pa.array([bpe.decode(x.tolist()) for x in ids], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(out, names=names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1])
    return frame.mapInArrow(run, f"{kept}, {added}")


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """documents -> doc_id, n_tokens, ids_sha256, decoded_sha256 (lowercase hex)."""
    out = encode_documents(docs.select("doc_id", "text"), vocabulary)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
