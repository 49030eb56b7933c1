import pytest

from leadflow.plans import fixtures

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("table, sql, column", [("documents", fixtures.HELP, "text"), ("conversations", fixtures.TURNS, "texto")])
def test_no_text_is_cut(spark, table, sql, column):
    given = [r["text"] for r in spark.read.parquet(f"{SMALL}/{table}.parquet").where("text is not null").select("text").collect()]
    made = [r[column] for r in fixtures.load(spark, SMALL, sql).collect()]
    for part in (lambda t: t.split("\n")[0], lambda t: t.split("\n", 1)[-1]):
        assert all(any(part(t) in m for m in made) for t in given)
