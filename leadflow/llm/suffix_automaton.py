"""Substring dedup over words: suffix automata of reference shards and matching statistics.

A shard is the set of different segments around one anchor (see repeats.py). Its automaton is
built once and sent along with the shard; each document's words are streamed through it for
matching statistics, the longest match that ends at each word and occurs elsewhere too. Spans of
`window` words or more go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.llm.common import pieces
from leadflow.llm.repeats import Kind, merged, packed, unpacked, with_spans

WINDOW = 35


class SuffixAutomaton:
    """Automaton of several sequences, with the number of sequences that each state occurs in (two at most)."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.seen, self.owners = [-1], [0]

    def add(self, sequence: list, owner: int) -> None:
        last = 0
        for symbol in sequence:
            last = self._extend(last, symbol)
            state = last
            while state > 0 and self.seen[state] != owner:  # all suffixes that end here belong to this sequence
                self.seen[state] = owner
                self.owners[state] += 1
                state = self.link[state]

    def _new(self, length: int, link: int, copied: int | None = None) -> int:
        self.next.append(dict(self.next[copied]) if copied is not None else {})
        self.length.append(length)
        self.link.append(link)
        self.seen.append(self.seen[copied] if copied is not None else -1)
        self.owners.append(self.owners[copied] if copied is not None else 0)
        return len(self.length) - 1

    def _split(self, state: int, symbol, target: int) -> int:
        clone = self._new(self.length[state] + 1, self.link[target], target)
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = clone
            state = self.link[state]
        self.link[target] = clone
        return clone

    def _extend(self, last: int, symbol) -> int:
        if (target := self.next[last].get(symbol)) is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
        state, new = last, self._new(self.length[last] + 1, 0)
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, symbol, target)
        return new

    def matching_statistics(self, sequence: list) -> list[int]:
        """For each place, the length of the longest stretch ending there that occurs in two sequences or more.

        The sequence may be any; for one of the automaton's own, that is a match elsewhere."""
        out, state, length = [], 0, 0
        for symbol in sequence:
            while state > 0 and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            shared = state
            while shared > 0 and self.owners[shared] < 2:
                shared = self.link[shared]
            out.append(length if shared == state else self.length[shared])
        return out


def shared_windows(window: int):
    """A comparison for repeats.py: words of each segment that a window found in another segment covers."""

    def compare(docs: np.ndarray, los: np.ndarray, segs: list[bytes]) -> tuple[list[int], list[int], list[int]]:
        automaton = SuffixAutomaton()
        sequences = [s.split() for s in segs]
        for owner, words in enumerate(sequences):
            automaton.add(words, owner)
        d, a, b = [], [], []
        for doc, lo, words in zip(docs.tolist(), los.tolist(), sequences):
            begin = end = -1
            for i, n in enumerate(automaton.matching_statistics(words)):
                if n >= window:
                    if end < 0:
                        begin = i + 1 - n
                    begin, end = min(begin, i + 1 - n), i + 1
                elif end >= 0 and i + 1 - window >= end:
                    d.append(doc), a.append(lo + begin), b.append(lo + end)
                    end = -1
            if end >= 0:
                d.append(doc), a.append(lo + begin), b.append(lo + end)
        return d, a, b

    return compare


def dedup_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with `kept` (the words that stay, joined by a space), `n_words` and `n_removed`.

    Words are runs without ASCII white space. A word goes if a window of `window` words that covers it
    also starts anywhere else, in the same document or another. Null texts have no words. Rows of equal
    doc_id and text are one document and get equal results; rows that share a doc_id alone, or have none,
    are different documents. All columns stay (those of the added names are replaced); an empty frame
    gives one.
    """
    rest = [c for c in docs.columns if c.lower() not in ("kept", "n_words", "n_removed")]
    kind = Kind("words", window, max(1, window // 4), keep_first=False)
    work = packed(docs, rest)
    own = work.columns
    marked = with_spans(work, kind, shared_windows(window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, most_bytes=16 << 20):
                kept, sizes, gone = [], [], []
                for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist()):
                    words = (text or "").encode().split()
                    edges = [0, *(x for s in merged(spans, len(words)) for x in s), len(words)]
                    stay = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
                    kept.append(b" ".join(stay).decode())
                    sizes.append(len(words))
                    gone.append(len(words) - len(stay))
                columns = [batch.column(c) for c in own]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], names=[*own, "kept", "n_words", "n_removed"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in work.schema.fields)
    out = marked.select(*own, "_spans").mapInArrow(run, f"{types}, kept string, n_words long, n_removed long")
    return out.select(*unpacked(rest), "kept", "n_words", "n_removed")


def digests(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, n_words, n_removed, kept_sha256."""
    return dedup_words(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def rewrite(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated passages removed from text; the same columns. Texts without one stay as they are, and
    n_chars, where present, follows the new text. A document of which nothing stays keeps its row, with text ""."""
    out = dedup_words(docs, window)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


#: The same rows in DuckDB: every window of 35 words by its MD5 value.
DIGESTS_SQL = r"""
WITH t AS (SELECT dense_rank() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS o, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS x FROM documents),
d AS (SELECT o, any_value(x) AS x, CAST(any_value(len(x)) AS BIGINT) AS n FROM t GROUP BY o),
w AS (SELECT o, i, md5_number(array_to_string(x[i + 1:i + 35], ' ')) AS g FROM (SELECT o, x, unnest(generate_series(0, n - 35)) AS i FROM d WHERE n >= 35)),
gone AS (SELECT o, i, coalesce(i - lag(i) OVER (PARTITION BY o ORDER BY i) > 35, true) AS opens FROM w JOIN (SELECT g FROM w GROUP BY g HAVING count(*) > 1) USING (g)),
s AS (SELECT o, min(i) AS a, max(i) + 35 AS b FROM (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY o ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM gone) GROUP BY o, run),
k AS (SELECT s.o, sum(b - a) AS n_removed, list_concat(flatten(list(x[before + 1:a] ORDER BY a)), any_value(x[final + 1:])) AS kept
  FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY o ORDER BY a), 0) AS before, max(b) OVER (PARTITION BY o) AS final FROM s) s JOIN d USING (o) GROUP BY s.o)
SELECT doc_id, CAST(len(x) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(coalesce(kept, x), ' '), '')) AS kept_sha256
FROM t LEFT JOIN k USING (o)
"""
