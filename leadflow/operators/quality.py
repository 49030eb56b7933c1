"""Checks: generic ones, and those of a day's assignments. Each gives rows {check, violations}."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _report(name: str, bad: DataFrame) -> DataFrame:
    return bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")


def not_null(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    return _report(name or f"not_null:{column}", df.where(F.col(column).isNull()))


def unique(df: DataFrame, *columns: str, name: str | None = None) -> DataFrame:
    return _report(name or f"unique:{','.join(columns)}", df.dropna(subset=list(columns)).groupBy(*columns).count().where("count > 1"))


def accepted_values(df: DataFrame, column: str, values: list, name: str | None = None) -> DataFrame:
    return _report(name or f"accepted_values:{column}", df.where(~F.col(column).isin(*values)))


def relationships(df: DataFrame, column: str, parent: DataFrame, parent_column: str, name: str | None = None) -> DataFrame:
    keys = parent.select(F.col(parent_column).alias(column)).distinct()
    return _report(name or f"relationships:{column}", df.where(F.col(column).isNotNull()).join(keys, column, "left_anti"))


def same_grain(a: DataFrame, b: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Keys that two tables have in different numbers."""
    x, y = a.groupBy(key).agg(F.count("*").alias("n")), b.groupBy(key).agg(F.count("*").alias("m"))
    return _report(name or f"same_grain:{key}", x.join(y, key, "full").where("coalesce(n, 0) != coalesce(m, 0)"))


def one_row_each(a: DataFrame, b: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """Keys that do not have exactly one row in each of two tables."""
    x, y = a.groupBy(key).agg(F.count("*").alias("n")), b.groupBy(key).agg(F.count("*").alias("m"))
    return _report(name or f"one_row_each:{key}", x.join(y, key, "full").where("coalesce(n, 0) != 1 or coalesce(m, 0) != 1"))


def one_company(identity: DataFrame, name: str = "one_company_per_identity") -> DataFrame:
    """Identities without exactly one company; a null is none."""
    return _report(name, identity.groupBy("customer_identity_id").agg(F.countDistinct("empresa_id").alias("n")).where("n != 1"))


def cross_company_signals_stay_apart(signals: DataFrame, identity: DataFrame) -> DataFrame:
    """Phones and e-mails of several companies of which one identity has rows in several companies."""
    some = signals.where(F.col("signal_type").isin("PHONE", "EMAIL"))
    key = ["signal_type", "signal_value"]
    shared = some.groupBy(*key).agg(F.countDistinct("empresa_id").alias("n")).where("n > 1").select(*key)
    held = signals.join(shared, key).join(identity.select("raw_row_id", "customer_identity_id"), "raw_row_id")
    return _report("cross_company_signals_stay_apart", held.groupBy(*key, "customer_identity_id").agg(F.countDistinct("empresa_id").alias("n")).where("n > 1"))


def signals_are_transitive(signals: DataFrame, identity: DataFrame) -> DataFrame:
    """Signal values of a company whose leads have more than one identity."""
    both = signals.where("empresa_id is not null").join(identity.select("raw_row_id", "customer_identity_id"), "raw_row_id")
    return _report("strong_signals_transitive", both.groupBy("empresa_id", "signal_type", "signal_value").agg(F.countDistinct("customer_identity_id").alias("n")).where("n > 1"))


def status_matches_sku(match: DataFrame) -> DataFrame:
    """Matched rows without a sku, and rows that are ambiguous, unmatched or without a model with one."""
    unmatched = F.col("match_status").isin("AMBIGUOUS", "UNMATCHED", "MISSING") & F.col("sku").isNotNull()
    return _report("matched_iff_sku", match.where((F.col("match_status") == "MATCHED") & F.col("sku").isNull() | unmatched))


def in_range(df: DataFrame, column: str, low: float, high: float, name: str | None = None) -> DataFrame:
    return _report(name or f"in_range:{column}", df.where((F.col(column) < low) | (F.col(column) > high)))


def lineage_equal(a: DataFrame, b: DataFrame, key: str, columns: list[str], name: str | None = None) -> DataFrame:
    """Rows of two tables with the same key of which a column differs; null equals null."""
    differ = reduce(lambda x, y: x | y, [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
    return _report(name or f"lineage:{','.join(columns)}", a.alias("a").join(b.alias("b"), F.col(f"a.{key}") == F.col(f"b.{key}")).where(differ))


def store_format(leads: DataFrame) -> DataFrame:
    """Stores that are not PV- and three digits."""
    return _report("store_format", leads.where(~F.col("punto_venta_id").rlike("^PV-[0-9]{3}$")))


def closed_follows_outcome(history: DataFrame) -> DataFrame:
    """Outcomes whose is_closed is another one than theirs: true when closed, false when lost, none when not managed."""
    o, closed = F.col("desenlace_normalizado"), F.col("is_closed")
    wrong = ((o == "cerrado") & ~closed.eqNullSafe(F.lit(True))) | ((o == "perdido") & ~closed.eqNullSafe(F.lit(False))) | ((o == "sin gestion") & closed.isNotNull())
    return _report("closed_follows_outcome", history.where(wrong))


def catalogue_values_positive(catalog: DataFrame) -> DataFrame:
    return _report("catalogue_values_positive", catalog.where("precio_lista <= 0 or unidades_disponibles < 0"))


def capacity_not_negative(advisors: DataFrame) -> DataFrame:
    return _report("capacity_not_negative", advisors.where("capacidad_diaria_leads < 0"))


def known_duplicates(df: DataFrame, lead_ids: tuple[str, ...], name: str) -> DataFrame:
    """Leads of which the source is known to hold two rows, and of which df has another number."""
    return _report(name, df.where(F.col("lead_id").isin(*lead_ids)).groupBy("lead_id").count().where("count != 2"))


def duplicates_share_identity(identity: DataFrame, leads: DataFrame, known: list[tuple[str, str]], name: str = "duplicates_share_identity") -> DataFrame:
    """Of leads {lead_id, empresa_id} that are known to be held twice: identities and companies with fewer than two of their rows, or with several lead ids."""
    expected = leads.sparkSession.createDataFrame(known, "lead_id string, empresa_id string")
    rows = identity.select("raw_row_id", "customer_identity_id").join(leads.select("raw_row_id", "lead_id", "empresa_id"), "raw_row_id").join(expected, ["lead_id", "empresa_id"])
    return _report(name, rows.groupBy("customer_identity_id", "empresa_id").agg(F.count("*").alias("n"), F.countDistinct("lead_id").alias("ids")).where("n < 2 or ids != 1"))


def lead_present(df: DataFrame, lead_id: str, name: str = "lead_present") -> DataFrame:
    """1 if no row has this lead, else 0."""
    return df.where(F.col("lead_id") == lead_id).agg((F.count("*") == 0).cast("long").alias("violations")).select(F.lit(name).alias("check"), "violations")


def conversation_count_positive(features: DataFrame) -> DataFrame:
    return _report("conversation_count_positive", features.where("conversation_count < 1"))


def operational_validation(assignments: DataFrame, mart: DataFrame, advisors: DataFrame, date: str) -> DataFrame:
    """Violations of a day: another number of rows than the mart's (1 or 0), scores outside 0..100, leads of unknown or
    inactive advisors, advisors over capacity, and leads of another company or store than their advisor's. The last two look
    at known advisors only, so an unknown one counts once."""
    day = assignments.where(F.col("assignment_date") == F.lit(date).cast("date"))
    given = day.where("assignment_status = 'ASSIGNED'").select("raw_row_id", "advisor_id", F.col("empresa_id").alias("e"), F.col("punto_venta_id").alias("p"))
    own = advisors.select(F.col("asesor_id").alias("advisor_id"), "empresa_id", "punto_venta_id", "activo", "capacidad_diaria_leads")
    known = given.join(own, "advisor_id")
    over = known.groupBy("advisor_id", "capacidad_diaria_leads").agg(F.count("*").alias("n")).where("n > coalesce(capacidad_diaria_leads, 0)")
    rows = day.agg(F.count("*").alias("n")).join(mart.agg(F.count("*").alias("m")))  # one row each
    return reduce(DataFrame.unionByName, [
        rows.select(F.lit("row_count_mismatch").alias("check"), (F.col("n") != F.col("m")).cast("long").alias("violations")),
        _report("scores_out_of_range", day.where("priority_score < 0 or priority_score > 100")),
        _report("inactive_assignments", given.join(own.where("activo").select("advisor_id"), "advisor_id", "left_anti")),
        _report("advisors_over_capacity", over),
        _report("invalid_company_store_assignments", known.where(~F.col("e").eqNullSafe(F.col("empresa_id")) | ~F.col("p").eqNullSafe(F.col("punto_venta_id")))),
    ])


def day_checks(assignments: DataFrame, mart: DataFrame, advisors: DataFrame, date: str) -> DataFrame:
    """A day looked at row by row, beside operational_validation: leads that it and the mart have in different numbers, scores
    outside 0..100 or without a value, leads of unknown or inactive advisors, advisors over capacity, and, each by itself, leads
    of another company and of another store than their advisor's. An unknown advisor has no capacity, company or store."""
    day = assignments.where(F.col("assignment_date") == F.lit(date).cast("date"))
    given = day.where("assignment_status = 'ASSIGNED'").select("raw_row_id", "advisor_id", F.col("empresa_id").alias("e"), F.col("punto_venta_id").alias("p"))
    both = given.join(advisors.select(F.col("asesor_id").alias("advisor_id"), "empresa_id", "punto_venta_id", "activo", "capacidad_diaria_leads"), "advisor_id", "left")
    over = both.groupBy("advisor_id").agg(F.count("*").alias("n"), F.max("capacidad_diaria_leads").alias("cap")).where("n > coalesce(cap, 0)")
    return reduce(DataFrame.unionByName, [
        same_grain(day, mart, "raw_row_id", "rows_match_mart"),
        _report("score_out_of_range", day.where("priority_score < 0 or priority_score > 100 or priority_score is null")),
        _report("inactive_or_missing_advisor", both.where(~F.coalesce("activo", F.lit(False)))),
        _report("over_capacity", over),
        _report("company_mismatch", both.where(~F.col("e").eqNullSafe(F.col("empresa_id")))),
        _report("store_mismatch", both.where(~F.col("p").eqNullSafe(F.col("punto_venta_id")))),
    ])


class ValidationFailed(ValueError):
    """A day's job must not go on; violations by check."""

    def __init__(self, violations: dict[str, int]):
        super().__init__(f"validation failed: {violations}")
        self.violations = violations


def require_valid(checks: DataFrame) -> dict[str, int]:
    """The checks {check, violations} by name if none has a violation; else ValidationFailed. A row a check comes to the driver."""
    found = {r["check"]: r["violations"] for r in checks.collect()}
    if bad := {k: v for k, v in sorted(found.items()) if v}:
        raise ValidationFailed(bad)
    return found
