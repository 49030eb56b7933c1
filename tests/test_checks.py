import duckdb
import pytest
from pyspark.sql import Row

from leadflow.operators import evaluation, quality
from leadflow.plans import oracles, queries


def n(report):
    return report.first()["violations"]


def test_grain(spark):
    twice, once = spark.createDataFrame([("a",), ("a",), ("b",)], "k string"), spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert n(quality.same_grain(twice, twice, "k")) == 0 and n(quality.one_row_each(twice, twice, "k")) == 1
    assert n(quality.same_grain(twice, once, "k")) == 2 == n(quality.one_row_each(twice, once, "k"))


def test_companies_and_signals(spark):
    who = spark.createDataFrame([("1", "i", "E1"), ("2", "i", "E2"), ("3", "j", None), ("4", "k", "E1")], "raw_row_id string, customer_identity_id string, empresa_id string")
    assert n(quality.one_company(who)) == 2  # two companies, and none
    signals = spark.createDataFrame([("1", "E1", "PHONE", "p"), ("2", "E2", "PHONE", "p"), ("4", "E1", "PHONE", "p"), ("1", "E1", "SOURCE_LEAD_ID", "x"), ("2", "E2", "SOURCE_LEAD_ID", "x")], "raw_row_id string, empresa_id string, signal_type string, signal_value string")
    assert n(quality.cross_company_signals_stay_apart(signals, who)) == 1 and n(quality.signals_are_transitive(signals, who)) == 1


def test_match_and_known_leads(spark):
    match = spark.createDataFrame([("MATCHED", None), ("MATCHED", "s"), ("REVIEW", "s"), ("AMBIGUOUS", "s"), ("MISSING", None)], "match_status string, sku string")
    assert n(quality.status_matches_sku(match)) == 2
    leads = spark.createDataFrame([("1", "L1", "E1"), ("2", "L1", "E1"), ("3", "L2", "E1")], "raw_row_id string, lead_id string, empresa_id string")
    who = spark.createDataFrame([("1", "i"), ("2", "i"), ("3", "j")], "raw_row_id string, customer_identity_id string")
    assert n(quality.duplicates_share_identity(who, leads, [("L1", "E1")])) == 0 and n(quality.duplicates_share_identity(who, leads, [("L1", "E1"), ("L2", "E1")])) == 1
    assert n(quality.lead_present(leads, "L2")) == 0 and n(quality.lead_present(leads, "L9")) == 1


def test_a_days_validation(spark):
    day = spark.createDataFrame([("1", "a", "E1", "P1", 10.0, "ASSIGNED"), ("2", "a", "E1", "P1", 101.0, "ASSIGNED"), ("3", "nobody", "E1", "P1", 1.0, "ASSIGNED"), ("4", "off", "E2", "P1", None, "ASSIGNED"), ("5", None, "E1", "P1", -1.0, "UNASSIGNED_CAPACITY")],
        "raw_row_id string, advisor_id string, empresa_id string, punto_venta_id string, priority_score double, assignment_status string").selectExpr("*", "date'2026-01-01' as assignment_date")
    advisors = spark.createDataFrame([("a", "E1", "P1", True, 1), ("off", "E1", "P1", False, 5)], "asesor_id string, empresa_id string, punto_venta_id string, activo boolean, capacidad_diaria_leads int")
    checks = quality.operational_validation(day, day.limit(4), advisors, "2026-01-01")
    assert {r["check"]: r["violations"] for r in checks.collect()} == {"row_count_mismatch": 1, "scores_out_of_range": 2, "inactive_assignments": 2, "advisors_over_capacity": 1, "invalid_company_store_assignments": 1}
    with pytest.raises(quality.ValidationFailed) as e:
        quality.require_valid(checks)
    assert e.value.violations["inactive_assignments"] == 2
    good = quality.operational_validation(day.where("raw_row_id = '1'"), day.limit(1), advisors, "2026-01-01")
    assert set(quality.require_valid(good).values()) == {0}


def test_a_day_row_by_row(spark):
    day = spark.createDataFrame([("1", "a", "E1", "P1", 10.0, "ASSIGNED"), ("2", "a", "E1", "P9", 101.0, "ASSIGNED"), ("3", "nobody", "E1", "P1", 1.0, "ASSIGNED"), ("4", "off", "E2", "P1", None, "ASSIGNED"), ("5", None, "E1", "P1", -1.0, "UNASSIGNED_CAPACITY")],
        "raw_row_id string, advisor_id string, empresa_id string, punto_venta_id string, priority_score double, assignment_status string").selectExpr("*", "date'2026-01-01' as assignment_date")
    advisors = spark.createDataFrame([("a", "E1", "P1", True, 1), ("off", "E1", "P1", False, 5)], "asesor_id string, empresa_id string, punto_venta_id string, activo boolean, capacidad_diaria_leads int")
    mart = day.where("raw_row_id != '5'").selectExpr("if(raw_row_id = '4', '6', raw_row_id) as raw_row_id")
    found = {r["check"]: r["violations"] for r in quality.day_checks(day, mart, advisors, "2026-01-01").collect()}
    assert found == {"rows_match_mart": 3, "score_out_of_range": 3, "inactive_or_missing_advisor": 2, "over_capacity": 2, "company_mismatch": 2, "store_mismatch": 2}
    con = duckdb.connect()
    for name, df in {"assignments": day, "leads_ai_enriched": mart, "stg_asesores": advisors}.items():
        con.register(name, df.toArrow())
    assert dict(con.execute(oracles.day_sql("")).fetchall()) == found


def test_validation_query_has_all_checks():
    sql = queries.ORACLES["operational_validation"]
    contracted = ["row_count_mismatch", "scores_out_of_range", "inactive_assignments", "advisors_over_capacity", "invalid_company_store_assignments"]
    for name in [*contracted, "rows_match_mart", "score_out_of_range", "inactive_or_missing_advisor", "over_capacity", "company_mismatch", "store_mismatch"]:
        assert f"'{name}' AS " in sql


def test_extraction_metrics(spark):
    fields = dict.fromkeys(evaluation.FIELDS)
    case = lambda status, ok, kind, seconds, told=True: Row(status=status, expected=Row(**fields), actual=Row(**fields) if told else None, error_type=kind, evidence_grounded=ok, latency_seconds=seconds)
    kind = ",".join(f"{f}:{'double' if f in evaluation.NUMBER_FIELDS else 'boolean' if f in evaluation.FLAG_FIELDS else 'string'}" for f in evaluation.FIELDS)
    schema = f"status string, expected struct<{kind}>, actual struct<{kind}>, error_type string, evidence_grounded boolean, latency_seconds double"
    one = lambda rows: evaluation.extraction_metrics(spark.createDataFrame(rows, schema)).first()
    r = one([case("ok", True, None, 2.0), case("ok", None, None, 4.0), case("error", False, "request_timeout", 100.0, False), case("error", None, None, None, False)])
    assert (r["cases"], r["success_rate"], r["mean_latency_seconds"], r["grounded_all"], r["grounding_failures"]) == (4, 0.5, 3.0, False, 1)
    assert r["errors_by_type"] == {"request_timeout": 1} and (r["macro_accuracy"], r["macro_accuracy_end_to_end"]) == (1.0, 0.5)
    none = one([case("error", None, "structured_output_invalid", 9.0, False)])
    assert none["grounded_all"] is None and none["mean_latency_seconds"] is None and none["structured_failures"] == 1 and none["macro_accuracy"] is None
