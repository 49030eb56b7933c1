import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from leadflow.llm import repeats, simhash, suffix_array, suffix_automaton


def order(d):
    return -(2**63) if d is None else d


def plain_bytes(rows, least=100):
    """kept bytes, removed bytes and runs by the definition; repeated rows are one document."""
    seen, out = {}, {}
    for d, t in sorted({(order(d), t or "") for d, t in rows}):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen.setdefault(b[i : i + least], (d, i)) != (d, i):
                gone[i : i + least] = b"\1" * least
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def plain_words(rows, window=35):
    texts = {order(d): (t or "").encode().split() for d, t in rows}
    count = Counter(b" ".join(w[i : i + window]) for w in texts.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in texts.items():
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if count[b" ".join(w[i : i + window])] > 1:
                gone[i : i + window] = b"\1" * window
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


def corpus(seed, n=60):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randrange(1, 6))) for _ in range(40)]
    shared = [" ".join(rnd.choice(words) for _ in range(rnd.choice([20, 40, 90]))) for _ in range(5)]
    out = []
    for i in range(n):
        parts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 50))) for _ in range(3)]
        out.append((i, rnd.choice([" ", "\n"]).join([parts[0], rnd.choice(shared), parts[1], rnd.choice(shared), parts[2]])))
    return [*out, (n, out[0][1]), (n + 1, out[0][1]), (n + 2, "ab" * 300), (n + 3, "x" * 99), (n + 4, "ab" * 60)]


def check(got, want):
    assert got and all(tuple(r[1:]) == want[order(r[0])] for r in got)


def test_bytes_against_brute_force(spark, docs, empty):
    rows = corpus(1)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(suffix_array.digests(frame).collect(), plain_bytes(rows))
    check(suffix_array.digests(docs).collect(), plain_bytes([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert suffix_array.digests(empty).count() == 0
    out = suffix_array.dedup_bytes(docs)
    assert set(out.columns) == {*docs.columns, "n_bytes", "removed"} and out.count() == docs.count()


def test_words_against_brute_force(spark, docs, empty):
    rows = corpus(2)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(suffix_automaton.digests(frame).collect(), plain_words(rows))
    check(suffix_automaton.digests(docs).collect(), plain_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert suffix_automaton.digests(empty).count() == 0
    kept = {r["doc_id"]: r for r in suffix_automaton.rewrite(docs).collect()}
    assert kept[5]["text"].count("\n") == 2 and "tail one" in kept[1]["text"] and kept[1]["n_chars"] == len(kept[1]["text"]) and kept[4]["text"] is None


def keyed_plain(frame, window, words):
    """Removed units of each (doc_id, text), by the definition; rows of equal key are one document."""
    rows = {(order(r["doc_id"]), r["k"], r["text"] or "") for r in frame.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).collect()}
    places, out = {}, {}
    for d, k, t in sorted(rows):
        units = t.encode().split() if words else t.encode()
        for i in range(len(units) - window + 1):
            places.setdefault(b" ".join(units[i : i + window]) if words else units[i : i + window], []).append((d, k, i))
        out[d, t] = set()
    text = {(d, k): t for d, k, t in rows}
    for at in places.values():
        for d, k, i in (at if len(at) > 1 else []) if words else at[1:]:
            out[d, text[d, k]] |= set(range(i, i + window))
    return {key: len(gone) for key, gone in out.items()}


def test_rows_without_ids_and_with_shared_ids(spark):
    """Unique text of rows that share a doc_id, or have none, stays, also when rows come out of a shuffle."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(90)) for _ in range(8)]
    rows = [(None, texts[0]), (None, texts[1] + " " + passage), (None, texts[2]), (2, "y" * 7 + passage), (2, texts[3]), (2, passage + " " + texts[4]), (2, passage + " " + texts[4]), (5, texts[5] + passage), (5, None), (6, ""), (None, None)]
    rows += [(100 + i, " ".join(word() for _ in range(30)) + " " + passage[: 200 + i]) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for shaken in (frame, frame.repartition(7), frame.repartition(3, "text").sortWithinPartitions(F.rand(3))):
        for run, words, size, total in ((suffix_array.dedup_bytes, False, 100, "n_bytes"), (suffix_automaton.dedup_words, True, 35, "n_words")):
            out = run(shaken)
            gone = F.col("n_removed") if words else F.col("n_bytes") - F.octet_length("kept")
            got = {(order(r["doc_id"]), r["text"] or ""): r["gone"] for r in out.select("doc_id", "text", gone.alias("gone")).collect()}
            assert got == keyed_plain(frame, size, words) and out.count() == len(rows)


def test_hot_groups_go_the_hashed_way(spark):
    """With a bound of one segment a group, every mixed group is compared by window hashes, with equal results."""
    rows = corpus(3)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for kind, compare, want in (
        (repeats.Kind("bytes", 100, 32, True, most_group=1), suffix_array.later_occurrences(100), {d: v[1] for d, v in plain_bytes(rows).items()}),
        (repeats.Kind("words", 35, 8, False, most_group=1), suffix_automaton.shared_windows(35), {d: v[1] for d, v in plain_words(rows).items()}),
    ):
        out = repeats.with_spans(frame, kind, compare).collect()
        assert {r["doc_id"]: sum(b - a for a, b in repeats.merged(r["_spans"], 10**9)) for r in out} == want


def test_long_documents_are_cut_into_sections(monkeypatch):
    rnd = random.Random(4)
    text = bytes(rnd.choice(b"abc") for _ in range(3000))
    whole = {(int(a + k), int(h)) for x in repeats.segments([repeats.byte_units(text)], 40, 12) for a, n, h in zip(x["lo"], x["n"], x["h"]) for k in range(n)}
    monkeypatch.setattr(repeats, "MOST_UNITS", 500)
    parts = {(int(a + k), int(h)) for x in repeats.segments([repeats.byte_units(text)], 40, 12) for a, n, h in zip(x["lo"], x["n"], x["h"]) for k in range(n)}
    assert whole == parts and len(whole) == len(text) - 39


def test_maximal_repeats():
    texts = [b"abcabcabx", b"zabcaby", b"q"]
    got = {(texts[o[0][0]][o[0][1] : o[0][1] + n], tuple(sorted(o))) for n, o in suffix_array.repeat_groups(texts, 3)}
    want = set()
    for n in range(3, 9):
        places = {}
        for t, s in enumerate(texts):
            for i in range(len(s) - n + 1):
                places.setdefault(s[i : i + n], []).append((t, i))
        for w, at in places.items():
            left = {texts[t][i - 1] if i else (t, i) for t, i in at}
            right = {texts[t][i + n] if i + n < len(texts[t]) else (t, i) for t, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((w, tuple(at)))
    assert got == want


def test_matching_statistics():
    rnd = random.Random(6)
    seqs = [[rnd.choice("ab") for _ in range(30)] for _ in range(4)]
    automaton = suffix_automaton.SuffixAutomaton()
    for k, s in enumerate(seqs):
        automaton.add(s, k)
    inside = lambda p, s: any(s[i : i + len(p)] == p for i in range(len(s) - len(p) + 1))
    for s in seqs:
        want = [max(n for n in range(i + 2) if n == 0 or sum(inside(s[i + 1 - n : i + 1], o) for o in seqs) > 1) for i in range(len(s))]
        assert automaton.matching_statistics(s) == want


def plain_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count() and simhash.near_duplicates(empty).count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(int(r["fingerprint"], 16) == plain_fingerprint(texts[r["doc_id"]]) for r in got)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[6] == 5 and by[4] == 3 and by[None] is None
    kept = simhash.keep_first(docs).collect()
    assert sorted((r["doc_id"] for r in kept), key=order) == sorted({k for k, c in by.items() if k == c}, key=order) and kept[0].asDict().keys() == set(docs.columns)


def test_links_are_complete(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randrange(5))) for b in base for _ in range(12)})
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = simhash.links(spark.createDataFrame(list(zip(signed, range(len(fps)))), "fp long, rep long")).collect()
    want = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 3}
    assert {tuple(sorted((r["u"], r["v"]))) for r in got} == want
