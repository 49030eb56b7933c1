"""Every operator on a frame whose other columns have the names it could use itself, with nulls and repeated rows."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from leadflow.llm import bpe, decontamination, html_text, media, quality, similar, simhash, suffix_array, suffix_automaton, toxicity

NAMES = ["_d", "_k", "_rest", "_spans", "__text", "text_", "own", "spans", "told", "more", "row", "w", "h1", "units", "clean", "Score_", "toxicity", "first", "fp", "n_hit", "found"]
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def frame(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, "some words and " + passage), (2, "others before " + passage + " and after"), (2, "a third text"), (None, None), (None, "no id"), (3, ""), (3, "")]
    rows = [(i, *r, *[f"{i}-{n}" for n in NAMES]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "at long, doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")


def held(rows):
    """Whether the columns that are not the operator's own came through unchanged."""
    return all(r[n] == f"{r['at']}-{n}" for r in rows for n in NAMES)


def test_rows_keep_their_other_columns(spark, frame, labels):
    model, judge = quality.fit(frame, labels), toxicity.fit(frame, labels)
    for run in (
        lambda d: bpe.encode_documents(d, VOCABULARY), media.media_columns, suffix_array.dedup_bytes, suffix_automaton.dedup_words, suffix_automaton.rewrite,
        lambda d: quality.score(d, model), lambda d: toxicity.score(d, judge), lambda d: html_text.extract(d.withColumn("html", F.col("text")).drop("text")),
    ):
        rows = run(frame).collect()
        assert len(rows) == frame.count() and held(rows)
        assert run(frame.limit(0)).count() == 0


def test_filters_keep_their_other_columns(spark, frame, labels):
    benchmark = spark.createDataFrame([(1, " ".join(f"P{i}" for i in range(20)))], "item_id long, text string")
    for run in (similar.keep_first, simhash.keep_first, lambda d: toxicity.keep_clean(d, labels, 1.1), lambda d: decontamination.decontaminate(d, benchmark), lambda d: decontamination.decontaminate(d, benchmark, mode="documents")):
        out = run(frame)
        assert out.columns == frame.columns and held(out.collect()) and run(frame.limit(0)).count() == 0
    texts = {r["at"]: r["text"] for r in decontamination.decontaminate(frame, benchmark).collect()}
    assert texts[0] == "some words and " + " ".join(f"p{i}" for i in range(20, 60)) and texts[3] is None and texts[4] == "no id" and len(texts) == 7


def test_fits_take_one_text_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(30)] + [(2, "bad one")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0)] * 5 + [(2, 1, 1)] * 5, "doc_id long, quality int, toxic int")
    assert len(toxicity.sample(docs, labels, each=10)) == 2
