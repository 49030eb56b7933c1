import random

from pyspark.sql import functions as F

from leadflow.operators import priority, reports
from leadflow.operators.ranking import group_rank


def leads(n=600):
    """Nine in ten leads in one store."""
    rng = random.Random(3)
    stores = [("E1", "P1")] * 9 + [("E2", "P2"), (None, "P3"), ("E3", None)]
    return [(f"{i:05}", *stores[rng.randrange(10) if rng.random() < 0.9 else rng.randrange(12)], rng.choice([1.0, 2.0, 50.0]), rng.choice([None, "2026-01-01", "2026-02-01"])) for i in range(n)]


SCHEMA = "raw_row_id string, empresa_id string, punto_venta_id string, priority_score double, fecha_registro string"


def order(r):
    return -r[3], r[4] is None, r[4] or "", r[0]


def test_a_hot_group_spans_tasks(spark):
    rows = leads()
    df = spark.createDataFrame(rows, SCHEMA)
    out = group_rank(df, [F.col("empresa_id"), F.col("punto_venta_id")], priority.queue_order(), "r", size="n", count=16)
    got = {r["raw_row_id"]: (r["r"], r["n"]) for r in out.collect()}
    assert out.columns == [*df.columns, "r", "n"] and len(got) == len(rows)
    for key in {r[1:3] for r in rows}:
        own = sorted((r for r in rows if r[1:3] == key), key=order)
        assert [got[r[0]] for r in own] == [(i + 1, len(own)) for i in range(len(own))]
    plan = out._jdf.queryExecution().toString()
    assert "windowspecdefinition(_part" in plan and group_rank(df.limit(0), [], [F.col("raw_row_id")]).count() == 0


def test_assignment_with_one_hot_store_equals_the_greedy_rule(spark):
    rows = leads()
    advisors = [("a1", "E1", "P1", True, 40), ("a2", "E1", "P1", True, 7), ("a3", "E1", "P1", False, 90), ("b", "E2", "P2", True, 3), ("c", None, "P3", True, 2), ("d", "E3", None, True, None)]
    ranked = priority.add_ranks(spark.createDataFrame(rows, SCHEMA))
    out = priority.assign_leads(ranked, spark.createDataFrame(advisors, "asesor_id string, empresa_id string, punto_venta_id string, activo boolean, capacidad_diaria_leads int"))
    again = priority.assign_leads(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(advisors, "asesor_id string, empresa_id string, punto_venta_id string, activo boolean, capacidad_diaria_leads int"))
    got = {r["raw_row_id"]: r for r in out.collect()}
    taken, want = {}, {}
    for r in sorted(rows, key=order):
        own = [a for a in advisors if a[3] and a[1:3] == r[1:3]]
        free = [a for a in own if taken.get(a[0], 0) < (a[4] or 0)]
        if free:
            best = min(free, key=lambda a: (taken.get(a[0], 0) / a[4], taken.get(a[0], 0), a[0]))[0]
            taken[best] = taken.get(best, 0) + 1
            want[r[0]] = (best, "ASSIGNED")
        else:
            want[r[0]] = (None, "UNASSIGNED_CAPACITY" if own else "NO_ELIGIBLE_ADVISOR")
    assert {k: (r["advisor_id"], r["assignment_status"]) for k, r in got.items()} == want == {r["raw_row_id"]: (r["advisor_id"], r["assignment_status"]) for r in again.collect()}
    assert [got[r[0]]["global_priority_rank"] for r in sorted(rows, key=order)] == list(range(1, len(rows) + 1))


def test_company_ranks_of_a_day(spark):
    rows = leads(200)
    day = spark.createDataFrame(rows, SCHEMA).withColumns({
        "assignment_date": F.lit("2026-03-01").cast("date"), "advisor_id": F.lit("a"), "assignment_status": F.lit("ASSIGNED"), "temperature": F.lit("HOT"), "lead_id": F.col("raw_row_id"), "global_priority_rank": F.lit(1),
        "priority_reasons": F.array(), "lead_age_hours": F.lit(1.0), "responded_at": F.lit(None).cast("string"), "responded_by": F.lit(None).cast("string"), "is_available_at_store": F.lit(True),
    })
    mart = spark.createDataFrame([(r[0], "n", "t", "e", "web", r[4], "m", "m", True) for r in rows], "raw_row_id string, nombre_cliente string, telefono_raw string, email_raw string, canal_normalizado string, fecha_registro string, modelo_canonico string, modelo_interes_normalizado string, is_available_at_store boolean")
    got = {r["raw_row_id"]: r["company_priority_rank"] for r in reports.daily_leads(day, mart, "2026-03-01", temperature="HOT").collect()}
    for company in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == company), key=order)
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))
