import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leadflow.llm import bpe, chat, decontamination, html_text, media, quality, toxicity, webp

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_equals_the_tokenizers_library(spark, docs, empty):
    ours, theirs = bpe.load(bpe.read_vocabulary(VOCABULARY)), Tokenizer.from_file(VOCABULARY)
    rnd = random.Random(1)
    signs = [chr(c) for c in [*range(0x250), 0x85, 0xA0, 0x1680, 0x2028, 0x3000, 0x200B, 0x1F600, 0x4E00, 0x661, 0x2160, 0x1C, 0x1F]]
    for i in range(2000):
        s = "".join(rnd.choice(signs if rnd.random() < 0.4 else "  \n\t'sdlabcaaa") for _ in range(rnd.randrange(50))) + "<|endoftext|>" * (i % 5 == 0)
        ids = theirs.encode(s, add_special_tokens=False).ids
        assert ours.encode(s).tolist() == ids and ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)
    rows = bpe.encode_documents(docs, VOCABULARY).collect()
    assert all(r["ids"] == theirs.encode(r["text"] or "", add_special_tokens=False).ids and r["decoded"] == (r["text"] or "") for r in rows)
    assert set(rows[0].asDict()) == {*docs.columns, "ids", "decoded"} and bpe.token_digests(empty, VOCABULARY).count() == 0


def plain_hits(text, items, n=10):
    words = lambda t: [w for w in "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")).split(" ") if w]
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        size = min(n, len(b))
        grams = {tuple(b[i : i + size]) for i in range(len(b) - size + 1)} if b else set()
        for i in range(len(w) - size + 1) if size else ():
            if tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(w), len(hit), len(found)


def test_decontamination(spark, docs, empty):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 4, 9, 10, 14, 25])))) for i in range(12)] + [(50, None), (51, " ,. "), (52, "it's 2026! ÜBER")]
    texts = [(i, " ".join(rnd.choice([*words, "W3,", "x-w1"]) for _ in range(rnd.randrange(60))) + (items[i % 12][1] or "")) for i in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for frame in (spark.createDataFrame(texts, "doc_id long, text string"), docs):
        want = sorted(plain_hits(r["text"], items) for r in frame.collect())
        got = decontamination.contamination_report(frame, benchmark).collect()
        assert sorted((r["n_words"], r["n_hit"], r["n_items"]) for r in got) == want and all(r["contaminated"] == (r["n_hit"] > 0) for r in got)
    assert decontamination.contamination_report(empty, benchmark).count() == 0
    assert decontamination.contamination_report(docs, benchmark.limit(0)).where("contaminated").count() == 0
    passage = spark.createDataFrame([(1, " ".join(f"p{i}" for i in range(12)))], "item_id long, text string")
    dirty = spark.createDataFrame([(1, "keep this, please. " + " ".join(f"P{i}," for i in range(12)) + " and that " + "more " * 20, 3), (2, "clean", 5), (3, None, None)], "doc_id long, text string, n_chars long")
    out = {r["doc_id"]: r for r in decontamination.decontaminate(dirty, passage).collect()}
    assert out[1]["text"] == "keep this, please. and that " + "more " * 20 and out[1]["n_chars"] == len(out[1]["text"]) and out[2]["n_chars"] == 5 and out[3]["text"] is None
    assert [r["doc_id"] for r in decontamination.decontaminate(dirty, passage, mode="documents").orderBy("doc_id").collect()] == [2, 3]


def test_string_kernel_against_brute_force():
    from itertools import combinations

    def plain(s, t, p, d):
        return sum(d ** (i[-1] - i[0] + j[-1] - j[0] + 2) for i in combinations(range(len(s)), p) for j in combinations(range(len(t)), p) if all(s[a] == t[b] for a, b in zip(i, j)))

    for s, t in (("idiot", "idiot"), ("ixdixot", "idiot"), ("worthless", "wrothlss"), ("abcabcab", "abcab"), ("aaaa", "aaaaa"), ("abc", "abcd")):
        got = toxicity.subsequence_kernel(toxicity._codes([s]), toxicity._codes([t])[0][: len(t)], 4, 0.7)[0]
        assert got == pytest.approx(plain(s, t, 4, 0.7), rel=1e-4)
    tokens = ["idiot", "xidiotx", "idxiot", "zqidyiozt", "lamp", "id", ""]
    sim = toxicity.Landmarks(["idiot"]).similarities(tokens)[:, 0]
    p, d = toxicity.LENGTH, toxicity.DECAY
    alike = lambda s, t: plain(s, t, p, d) ** 2 / (plain(s, s, p, d) * plain(t, t, p, d)) if len(s) >= p else 0
    assert sim == pytest.approx([alike(t, "idiot") for t in tokens], rel=1e-3) and sim[0] == pytest.approx(1) and 0 < sim[2] < 1
    # a sentence's kernel with a landmark is the sum over its tokens
    pooled, owner = toxicity.TokenTable(toxicity.Landmarks(["idiot"])).pooled([toxicity.sentences("An idiot, xidiotx. Lamp"), []])
    assert pooled[:, 0] == pytest.approx([1 + sim[1], 0, 0], rel=1e-3) and owner.tolist() == [0, 0, 1]


def labelled(spark, column):
    rnd = random.Random(3)
    plain = ["".join(rnd.choice("abenorst") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    docs, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        lines = [" ".join(rnd.choice(plain) for _ in range(12)) + "." for _ in range(3)]
        if bad and column == "toxic":
            lines[1] = "you " + rnd.choice(["zugwurm", "klimpfig", "zugwurm!"]) + " " + lines[1]
        if bad and column == "quality":
            lines = [" ".join(w.upper() + "!!" for w in x.split()) for x in lines]
        docs.append((i, "\n".join(lines)))
        labels.append((i, int(bad) if column == "toxic" else int(not bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (7, None)], f"doc_id long, {column} int")


def test_toxicity(spark, docs, empty):
    frame, labels = labelled(spark, "toxic")
    rows = toxicity.toxicity_scores(frame, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 == 0) for r in rows if r["held_out"]]) > 0.97
    model = toxicity.fit(frame, labels)
    probe = spark.createDataFrame([(1, "a zug-wurm"), (2, "z u g w u r m"), (3, "lamp"), (4, None)], "doc_id long, text string")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(probe, model).collect()}
    assert scores[1] > 0.3 and scores[2] > 0.3 and scores[3] < 0.3 and scores[4] < 0.3
    got = toxicity.score(docs, model)
    assert got.count() == docs.count() and set(got.columns) == {*docs.columns, "score"} and toxicity.score(empty, model).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).where("score between 0 and 1").count() == docs.count()
    assert set(toxicity.keep_clean(docs, labels).columns) == set(docs.columns)


def test_quality(spark, docs, empty):
    frame, labels = labelled(spark, "quality")
    rows = quality.quality_scores(frame, labels).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 5 != 0) for r in rows if r["held_out"]]) > 0.97
    assert quality.quality_scores(docs, labels.limit(0)).where("score between 0 and 1").count() == docs.count()
    assert quality.score(empty, quality.fit(frame, labels)).count() == 0


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(0)
    score, change, counts = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([3, 1, 5])
    good, expected, log_z = quality.forward_backward(score, counts, change)
    at, want, total = 0, [], 0.0
    for n in counts:
        s = score[at : at + n]
        weights = {y: np.exp(s @ np.array(y) + sum(change[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        want += list(sum(np.array(y) * w for y, w in weights.items()) / z)
        total += np.log(z)
        at += n
    assert np.allclose(good, want) and log_z == pytest.approx(total) and expected.sum() == pytest.approx(6)


def test_webp_round_trips():
    rng = np.random.default_rng(1)
    files, images = [], []
    for trial in range(24):
        h, w = rng.integers(1, 30, 2)
        kind = trial % 4
        if kind == 0:
            px = rng.integers(0, 2**32, (h, w), dtype=np.uint32)
        elif kind == 1:
            px = rng.choice(rng.integers(0, 2**32, rng.integers(1, 20), dtype=np.uint32), (h, w))
        elif kind == 2:
            px = (np.add.outer(np.arange(h) * 3, np.arange(w) * 2).astype(np.uint32) % 256) * np.uint32(0x010203) | np.uint32(0xFF000000)
        else:
            px = rng.integers(0, 3, (h, w), dtype=np.uint32) * np.uint32(0x102030) | np.uint32(0xFF000000)
        for transforms in ((), (0,), (1,), (2,), (0, 1, 2), (2, 0), (3,)):
            if transforms != (3,) or len(np.unique(px)) <= 256:
                for cache, blocks in ((0, None), (4, None), (3, 2)):
                    files.append(webp.encode(px, transforms, 2 + trial % 3, cache, True, blocks))
                    images.append(px)
    assert all((a == b).all() for a, b in zip(webp.decode_batch(files), images))
    assert all((webp.decode_batch([f])[0] == i).all() for f, i in zip(files[::40], images[::40]))
    for broken in (b"", files[0][:30], b"RIFF" + files[0][4:40]):
        with pytest.raises(ValueError):
            webp.decode_batch([broken])


def test_media(spark, docs, empty):
    rows = media.media_columns(docs).collect()
    for r in rows:
        text = (r["text"] or "").encode()
        assert r["payload"] == media.padded(text) and r["n_bytes"] == len(text) and len(r["payload"]) % 192 == 0 and bytes(r["media"][8:16]) == b"WEBPVP8L"
    assert media.media_digests(empty).count() == 0
    samples = [bytes(random.Random(i).choices(range(32, 127), k=i)) for i in range(1, 700, 7)] + [b" " * 9000, b"x" * 3_200_000]
    files = media.store(samples)
    assert [media.from_pixels(p, media.payload_length(f, p)) for f, p in zip(files, webp.decode_batch(files))] == [media.padded(s) for s in samples]


def test_html():
    page = """<html><head><title>T</title><style>.x, #y{display:none}</style></head><body><h1>Head</h1><p>One<p>Two <b>bold</b>
 text<ul><li>a<li>b<ul><li>n1<li>n2</ul><li>c</ul><ol start=3><li><p>para</p><p>second</p><li>z</ol>
<table><caption>cap<tr><th>Name<th>Qty<tr><td>apple<td>10<tr><td>fig &amp; plum<td>2<br>more</table>after<div class=x>no</div><div hidden>no</div>
<span style="display: none">no</span><pre>
 a
   b</pre>tail<br>line2<script>no</script></body></html>"""
    want = """Head

One

Two bold text

- a
- b
  - n1
  - n2
- c

3. para

   second

4. z

cap
Name       | Qty
apple      | 10
fig & plum | 2
           | more

after

 a
   b

tail
line2"""
    assert html_text.page_text(page) == want
    assert html_text.page_text(None) == html_text.page_text("") == ""
    assert html_text.page_text("<div>" * 30000 + "x") == "x"
    assert html_text.page_text("<td>a<td>b") == "a\nb" and html_text.page_text("<table><tr><td colspan=2>a<td>b<tr><td>1<td>2<td>3</table>") == "a |   | b\n1 | 2 | 3"
    assert "x" in html_text.page_text("<table>" * 30 + "<tr><td>x")


def test_html_frame(spark, empty):
    pages = spark.createDataFrame([(1, None, "t"), (None, "<p>a", "u"), (1, "<p>a", None)], "page_id long, html string, text string")
    assert [r["text"] for r in html_text.extract(pages).orderBy(F.col("page_id").desc_nulls_last(), "text").collect()] == ["", "a", "a"]


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ana", "hi <|x"), (1, 2, "bob", "yo"), (1, 3, "ana", None), (2, 0, "system", "only"), (None, 5, "ana", "alone"), (None, 5, "ana", "alone"), (3, None, None, "t"), (1, 600, "bob", "later")]
    out = chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {(r["conv_id"], r["part"], r["perspective"]): r for r in out if r["conv_id"] is not None}
    assert set(by) == {(1, 0, "ana"), (1, 0, "bob"), (2, 0, None), (3, 0, "unknown")} and sum(r["conv_id"] is None for r in out) == 2
    ana = by[1, 0, "ana"]
    assert ana["text"] == "<|system|>\ns<|end|>\n<|assistant|>\nhi < |x<|end|>\n<|user:bob|>\nyo<|end|>\n<|assistant|>\n<|end|>\n<|user:bob|>\nlater<|end|>\n"
    assert [ana["text"][m["start"] : m["end"]] for m in ana["mask"]] == ["hi < |x<|end|>\n", "<|end|>\n"] and by[2, 0, None]["mask"] == []
