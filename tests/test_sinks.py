import pytest

from leadflow.operators import merge
from leadflow.sources import sinks


def test_sinks(spark, tmp_path):
    rows = [("2026-01-01", 1, "a,b \"c\"", ["x", None]), ("2026-01-01", 2, None, None), ("2026-01-02", 3, "", [])]
    df = spark.createDataFrame(rows, "day string, k int, t string, xs array<string>")
    mart = str(tmp_path / "mart")
    sinks.write_mart(df, mart, ["day"])
    sinks.write_mart(df.where("k = 3").selectExpr("day", "k + 10 as k", "t", "xs"), mart, ["day"])
    assert sorted(r["k"] for r in spark.read.parquet(mart).collect()) == [1, 2, 13]
    sinks.write_csv_report(df, str(tmp_path / "csv"))
    back = {r["k"]: r for r in spark.read.option("header", True).option("escape", '"').option("inferSchema", True).csv(str(tmp_path / "csv")).collect()}
    assert back[1]["t"] == "a,b \"c\"" and back[1]["xs"] == '["x",null]' and back[2]["t"] is None and len(back) == 3
    sinks.write_json_report(df, str(tmp_path / "json"))
    assert sorted(map(tuple, spark.read.schema(df.schema).json(str(tmp_path / "json")).collect()), key=lambda r: r[1]) == rows
    sinks.write_csv_report(df.limit(0), str(tmp_path / "none"))


def test_upsert_of_repeated_keys(spark):
    t = spark.createDataFrame([("a", 1, 0)], "k string, v int, at int")
    u = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("b", 4, None), (None, 5, 1), (None, 6, 3)], "k string, v int, at int")
    assert {(r["k"], r["v"]) for r in merge.upsert(t, u, ["k"], newest="at").collect()} == {("a", 3), ("b", 4), (None, 6)}
    with pytest.raises(Exception, match="repeat a key"):
        merge.upsert(t, u, ["k"]).collect()
