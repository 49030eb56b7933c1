import itertools
import re

import numpy as np

from leadflow.llm import line_rules, quality


def test_viterbi_finds_the_best_of_all_sequences():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = rng.integers(1, 8, 5)
        score, change = rng.normal(0, 2, counts.sum()), rng.normal(0, 1.5, (2, 2))
        got = line_rules.viterbi(score, counts, change)
        for y, s in zip(np.split(got, np.cumsum(counts)[:-1]), np.split(score, np.cumsum(counts)[:-1])):
            value = lambda y: sum(v for v, a in zip(s, y) if a) + sum(change[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
            assert np.isclose(value(tuple(y)), max(map(value, itertools.product((0, 1), repeat=len(s)))))


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {j for i, w in enumerate(windows) if w in often for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts_equal_brute_force():
    rng = np.random.default_rng(4)
    texts = ["", " \n\t", "a b c d e f a b c d e", "x y z w", "l\r\nl\nl\r\n \n \n# | <b>", "la " * 200, "☃ ñ\x0b💡\x0cq 1 2 3 4 ☃ ñ 💡 q 1", "tail\n", "a b c d", "a b c d e", "a b c d e"]
    texts += [" ".join(rng.choice(list("ab\n|é"), n)) for n in (5, 9, 40, 40, 200)] + [f"w{i}" for i in range(3)]
    got = line_rules.base_counts([t.encode() for t in texts])
    assert [tuple(int(got[c][i]) for c in line_rules.COUNTS) for i in range(len(texts))] == [plain(t) for t in texts]
    failed = line_rules.base_failed(got)
    assert [bool(f) for f in failed] == [n < 10 or 100 * r > 20 * n for n, _, _, _, r in map(plain, texts)]
    none = line_rules.base_counts([])
    assert all(len(none[c]) == 0 for c in line_rules.COUNTS)


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r["doc_id"]: r for r in line_rules.rule_rows(docs, labels).collect()}
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] for r in docs.limit(120).collect()}
    for i, text in texts.items():
        assert tuple(rows[i][c] for c in line_rules.COUNTS) == plain(text)
    known = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect()]
    assert np.mean([r["kept"] for r, q in known if q == 1 and not r["base_failed"]]) > 0.97
    assert np.mean([r["kept"] for r, q in known if q == 0]) < 0.1


def test_rows_that_are_odd(spark, docs, empty):
    model = quality.fit(docs, spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, quality int"))
    told = docs.withColumnRenamed("kept", "Judgement").withColumnRenamed("source", "text_")
    out = line_rules.judge(told, model)
    assert out.columns == [c for c in told.columns if c != "Judgement"] + ["judgement"]
    rows = out.collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    for i in (3, 4):
        assert by[i]["judgement"]["n_words"] == 0 and by[i]["judgement"]["base_failed"] and not by[i]["judgement"]["kept"]
    for r in rows:
        j, lines = r["judgement"], (r["text"] or "").split("\n")
        inside = [k for s in j["content"] for k in range(s["first"], s["past"])]
        size = [max(1, len(x.encode())) for x in lines]
        assert np.isclose(j["content_share"], sum(size[k] for k in inside) / sum(size))
    same = [r["judgement"] for r in rows if r["text"] == "same text here\nand a line\nand a line"]
    assert len(same) == 3 and same[0] == same[1] == same[2] and same[0]["n_dup_lines"] == 1
    assert line_rules.judge(empty, model).count() == 0
    labels = spark.createDataFrame([(1, 1), (7, 0)], "doc_id long, quality int")
    assert line_rules.keep_content(docs, labels).columns == docs.columns and line_rules.keep_content(empty, labels).count() == 0
