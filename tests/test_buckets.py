from pathlib import Path

from leadflow.operators import merge


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "scores")
    old = spark.createDataFrame([(f"r{i}", None if i % 9 == 0 else i % 3, float(i), "old") for i in range(300)], "k string, j int, score double, version string")
    new = spark.createDataFrame([("r5", 2, 50.0, "new"), ("r9", None, 90.0, "new"), ("fresh", None, 1.0, "new"), ("fresh", None, 2.0, "newer")], "k string, j int, score double, version string")
    merge.write_buckets(old, path, ["k", "j"], 16)
    before = files(path)
    assert len({f.split("/")[0] for f in before}) == 16
    touched = merge.upsert_buckets(path, new, ["k", "j"], 16, newest="score")
    after = files(path)
    assert 1 <= len(touched) <= 3
    assert {f for f in before if int(f.split("/")[0].split("=")[1]) not in touched} == before & after
    got = spark.read.parquet(path).drop("_bucket")
    want = merge.upsert(old, new, ["k", "j"], newest="score")
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect())) and got.count() == 301
    assert merge.upsert_buckets(path, new.limit(0), ["k", "j"], 16) == [] and files(path) == after
