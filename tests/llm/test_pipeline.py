from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadflow.llm.queries import oracles, queries
from test_similar import plain_components

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    label = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    now, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in now.select("doc_id", "text").collect()}
        now = spark.createDataFrame(stage(spark, now, SMALL).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in now.collect()}
        assert now.columns == columns and set(after) <= set(before)
        if name == "toxicity":
            assert sum(label.get(d) == 0 for d in before) - sum(label.get(d) == 0 for d in after) <= 3
        if name == "simhash_near_dedup":
            assert set(after) == {d for d, c in plain_components(list(before.items())).items() if c == d}
        if name == "substring_dedup":
            cut = lambda t: [" ".join(t.split()[i : i + 35]) for i in range(len(t.split()) - 34)]
            often = Counter(w for t in before.values() for w in cut(t or ""))
            assert len(after) == len(before) and not any(often[w] > 1 for t in after.values() for w in cut(t or ""))
    last = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
    assert last.where(F.col("decoded") != F.col("text")).count() == 0 and last.count() == now.count()


@pytest.mark.parametrize("name", sorted(oracles()))
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries()[name](spark, SMALL)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracles()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
