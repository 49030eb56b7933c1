"""Reports over one day's assignments and the lead mart."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.operators.ranking import group_rank


@dataclass(frozen=True)
class Scope:
    """Who asks: a manager sees a company, an advisor their own leads of it; no company: all (for reports by company)."""

    empresa_id: str | None = None
    advisor_id: str | None = None

    def filter(self) -> Column:
        test = F.lit(True)
        if self.empresa_id is not None:
            test = test & (F.col("empresa_id") == self.empresa_id)
        if self.advisor_id is not None:
            test = test & (F.col("advisor_id") == self.advisor_id)
        return test


def available_dates(assignments: DataFrame, scope: Scope = Scope()) -> DataFrame:
    return assignments.where(scope.filter()).select("assignment_date").distinct().orderBy(F.col("assignment_date").desc())


def _day(assignments: DataFrame, date: str, scope: Scope) -> DataFrame:
    return assignments.where((F.col("assignment_date") == F.lit(date).cast("date")) & scope.filter())


def daily_leads(assignments: DataFrame, mart: DataFrame, date: str, scope: Scope = Scope(), *, temperature=None, assignment_status=None, canal=None, availability=None, advisor_id=None, punto_venta_id=None, search=None, management_status=None) -> DataFrame:
    """The queue of a day: ranked within the company first, then filtered. `search` looks for a part of the name, id,
    phone or model, whatever its case; advisor_id counts for managers only."""
    more = mart.select("raw_row_id", "nombre_cliente", "telefono_raw", "email_raw", "canal_normalizado", "fecha_registro", F.coalesce("modelo_canonico", "modelo_interes_normalizado").alias("modelo"), "is_available_at_store")
    day = _day(assignments, date, scope).drop("fecha_registro", "is_available_at_store").join(more, "raw_row_id")
    order = [F.col("priority_score").desc(), F.col("fecha_registro").asc_nulls_last(), F.col("raw_row_id").asc()]
    ranked = group_rank(day.select("raw_row_id", "empresa_id", "priority_score", "fecha_registro"), [F.col("empresa_id")], order, "company_priority_rank")
    day = day.join(ranked.select("raw_row_id", "company_priority_rank"), "raw_row_id")
    wanted = {"temperature": temperature, "assignment_status": assignment_status, "canal_normalizado": canal, "punto_venta_id": punto_venta_id, "advisor_id": advisor_id if scope.advisor_id is None else None}
    for column, value in wanted.items():
        if value is not None:
            day = day.where(F.col(column) == value)
    if availability is not None:
        day = day.where(F.col("is_available_at_store").eqNullSafe(F.lit(availability)))
    if management_status is not None:
        day = day.where(F.col("responded_at").isNotNull() if management_status == "RESPONDED" else F.col("responded_at").isNull())
    if search:
        test = F.lit(False)
        for column in ("nombre_cliente", "lead_id", "telefono_raw", "modelo"):
            test = test | F.coalesce(F.col(column).ilike(f"%{search}%"), F.lit(False))
        day = day.where(test)
    return day.select(
        "raw_row_id", "lead_id", "empresa_id", "punto_venta_id", "nombre_cliente", F.col("telefono_raw").alias("telefono"), F.col("email_raw").alias("email"),
        F.col("canal_normalizado").alias("canal"), "fecha_registro", "modelo", "is_available_at_store", "priority_score", "global_priority_rank", "company_priority_rank",
        "temperature", "priority_reasons", "advisor_id", "assignment_status", "lead_age_hours", "responded_at", "responded_by",
    )


def lead_detail(assignments: DataFrame, mart: DataFrame, date: str, raw_row_id: str, scope: Scope = Scope()) -> DataFrame:
    day = _day(assignments, date, scope).where(F.col("raw_row_id") == raw_row_id)
    extra = [c for c in mart.columns if c == "raw_row_id" or c not in assignments.columns]
    return day.join(mart.select(*extra), "raw_row_id")


def manager_summary(assignments: DataFrame, advisors: DataFrame, date: str, scope: Scope = Scope()) -> DataFrame:
    """Thirteen measures of each company's day."""
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    status, heat = F.col("assignment_status"), F.col("temperature")
    assigned, waiting, answered = status == "ASSIGNED", status == "UNASSIGNED_CAPACITY", F.col("responded_at").isNotNull()
    counts = _day(assignments, date, scope).groupBy("empresa_id").agg(
        F.count("*").alias("total_leads"), n(assigned).alias("assigned"), n(waiting).alias("backlog"), n(status == "NO_ELIGIBLE_ADVISOR").alias("no_eligible"),
        n(heat == "HOT").alias("hot"), n(heat == "WARM").alias("warm"), n(heat == "COLD").alias("cold"), n((heat == "HOT") & waiting).alias("hot_backlog"),
        n(assigned & answered).alias("responded"), n(assigned & ~answered).alias("pending_response"),
    )
    room = advisors.where("activo").groupBy("empresa_id").agg(F.sum("capacidad_diaria_leads").cast("long").alias("capacity_total"))
    share = F.round(F.lit(100).cast("decimal(20,4)") * F.col("responded") / F.when(F.col("assigned") > 0, F.col("assigned")), 2)
    out = counts.join(room, "empresa_id", "left").withColumns({"capacity_total": F.coalesce("capacity_total", F.lit(0).cast("long")), "capacity_used": F.col("assigned")})
    return out.withColumn("managed_pct", F.coalesce(share, F.lit(0)).cast("double"))


def advisor_capacity(assignments: DataFrame, advisors: DataFrame, date: str, scope: Scope = Scope()) -> DataFrame:
    """Load of each active advisor; those without leads are kept, and a capacity of 0 has no ratio."""
    done = _day(assignments, date, scope).where("assignment_status = 'ASSIGNED'").groupBy("advisor_id").agg(F.count("*").alias("a"), F.count("responded_at").alias("r"))
    here = advisors.where("activo")
    if scope.empresa_id is not None:
        here = here.where(F.col("empresa_id") == scope.empresa_id)
    both = here.join(done, here["asesor_id"] == done["advisor_id"], "left")
    a, r = F.coalesce("a", F.lit(0)), F.coalesce("r", F.lit(0))
    room = F.col("capacidad_diaria_leads")
    return both.select("empresa_id", "asesor_id", "nombre", "punto_venta_id", room.cast("long").alias("capacidad"), a.alias("asignados"), r.alias("responded"), (a - r).alias("pending_response"), (a / F.when(room > 0, room)).alias("load_ratio"))


def store_summary(assignments: DataFrame, advisors: DataFrame, date: str, scope: Scope = Scope()) -> DataFrame:
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    counts = _day(assignments, date, scope).groupBy("empresa_id", "punto_venta_id").agg(
        F.count("*").alias("leads"), n(F.col("assignment_status") == "ASSIGNED").alias("assigned"), n(F.col("assignment_status") == "UNASSIGNED_CAPACITY").alias("backlog"), n(F.col("temperature") == "HOT").alias("hot"),
    )
    room = advisors.where("activo").groupBy("empresa_id", "punto_venta_id").agg(F.sum("capacidad_diaria_leads").cast("long").alias("capacity"))
    return counts.join(room, ["empresa_id", "punto_venta_id"], "left").withColumn("capacity", F.coalesce("capacity", F.lit(0).cast("long")))


def filter_options(assignments: DataFrame, mart: DataFrame, advisors: DataFrame, date: str, scope: Scope = Scope()) -> DataFrame:
    """Distinct store, advisor, advisor's name and channel of a day."""
    day = _day(assignments, date, scope).select("raw_row_id", "punto_venta_id", "advisor_id").join(mart.select("raw_row_id", F.col("canal_normalizado").alias("canal")), "raw_row_id")
    return day.join(advisors.select(F.col("asesor_id").alias("advisor_id"), F.col("nombre").alias("advisor_name")), "advisor_id", "left").select("punto_venta_id", "advisor_id", "advisor_name", "canal").distinct()


def lead_history(messages: DataFrame, assignments: DataFrame, date: str, raw_row_id: str | None = None, scope: Scope = Scope()) -> DataFrame:
    """Conversation messages of the leads in scope, in order within each conversation."""
    day = _day(assignments, date, scope)
    if raw_row_id is not None:
        day = day.where(F.col("raw_row_id") == raw_row_id)
    return messages.join(day.select("lead_id").distinct(), "lead_id", "left_semi").orderBy("lead_id", F.col("conversation_started_at").asc_nulls_last(), "conversation_id", "message_index")


def apply_responded(assignments: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Toggles {assignment_date, raw_row_id, empresa_id, advisor_id, responded, at, by, event_id} applied, the latest of
    each lead; only to rows assigned to that advisor of that company. Gives the assignments and the events that had no right."""
    key = ["assignment_date", "raw_row_id"]
    own = assignments.where("assignment_status = 'ASSIGNED'").select(*key, "empresa_id", "advisor_id").withColumn("_ok", F.lit(True))
    known = events.join(own, [*key, "empresa_id", "advisor_id"], "left")
    rejects = known.where("_ok is null").drop("_ok")
    last = known.where("_ok").groupBy(*key).agg(F.max_by(F.struct("responded", "at", "by"), F.struct("at", "event_id")).alias("_e"))
    out = assignments.join(last, key, "left")
    new = lambda old, field: F.when(F.col("_e").isNull(), F.col(old)).when(F.col("_e.responded"), F.col(f"_e.{field}"))
    return out.withColumns({"responded_at": new("responded_at", "at"), "responded_by": new("responded_by", "by")}).drop("_e"), rejects
