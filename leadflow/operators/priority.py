"""Daily priority and assignment of leads to advisors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.operators.ranking import group_rank
from leadflow.plans.session import materialise

# Fixed values of the contract: points of an intent, and the reason that goes with each number of points.
INTENT_POINTS = {"alta": 15, "media": 8, "baja": 2}
SLA_REASONS = {30.0: "Lead esperando más de 48 h", 20.0: "Lead esperando entre 24 y 48 h", 10.0: "Lead esperando entre 12 y 24 h", 5.0: "Lead esperando entre 4 y 12 h"}
AVAILABILITY_REASONS = {20.0: "Producto disponible", 8.0: "Disponibilidad desconocida"}
PROPENSITY_REASONS = {5.0: "Propensión histórica en top 20%", 3.0: "Propensión histórica entre percentiles 50 y 80", 1.0: "Propensión histórica entre percentiles 20 y 50"}


def _pick(tests: list[tuple[Column, object]], other) -> Column:
    out = None
    for test, value in tests:
        out = (F if out is None else out).when(test, value)
    return out.otherwise(other)


def conversation_component() -> tuple[Column, Column]:
    """Points (45 at most) and reasons of what the conversations tell."""
    c, talked = F.col, F.coalesce("has_conversation", F.lit(False))
    yes = lambda test: F.coalesce(test, F.lit(False)) & talked
    intent = c("conversation_intencion")
    parts = [(yes(intent == k), v, F.concat(F.lit("Intención "), intent)) for k, v in INTENT_POINTS.items()]
    parts += [
        (yes(c("conversation_pidio_cita")), 10, F.lit("Solicitó cita")),
        (yes(c("conversation_pidio_cotizacion")), 8, F.lit("Solicitó cotización")),
        (yes((c("conversation_cuota_inicial") > 0) & (c("conversation_forma_pago") == "credito")), 7, F.lit("Reportó cuota inicial")),
        (yes(c("conversation_forma_pago").isin("credito", "contado")), 5, F.lit("Forma de pago informada")),
    ]
    points = F.lit(0.0)
    for test, value, _ in parts:
        points = points + F.when(test, float(value)).otherwise(0.0)
    return F.least(points, F.lit(45.0)), F.array_compact(F.array(*[F.when(t, r) for t, _, r in parts]))


def sla_component(age: Column) -> Column:
    return _pick([(age >= h, p) for h, p in ((48, 30.0), (24, 20.0), (12, 10.0), (4, 5.0))], 0.0)


def availability_component(there: Column) -> Column:
    return _pick([(there, 20.0), (there.isNull(), 8.0)], 0.0)


def propensity_component(percentile: Column) -> Column:
    return _pick([(percentile >= p, v) for p, v in ((0.8, 5.0), (0.5, 3.0), (0.2, 1.0))], 0.0)


def age_hours(date: Column, now: Column) -> Column:
    """Hours since midnight of the date; none for a missing or future date."""
    return F.coalesce(F.greatest((F.unix_timestamp(now) - F.unix_timestamp(date.cast("timestamp"))) / 3600, F.lit(0.0)), F.lit(0.0))


def propensity_percentile(df: DataFrame) -> DataFrame:
    """df with propensity_percentile: place / (n - 1) by (score, raw_row_id); null scores have none and don't count."""
    scored = df.where("propensity_score is not null").select("raw_row_id", "propensity_score")
    ranked = group_rank(scored, [], [F.col("propensity_score").asc(), F.col("raw_row_id").asc()], "_rank", size="_n")
    share = ranked.select("raw_row_id", ((F.col("_rank") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).alias("propensity_percentile"))
    return df.join(share, "raw_row_id", "left")


def score_leads(df: DataFrame, scoring_timestamp: str) -> DataFrame:
    """Score 0 to 100, temperature, components and reasons of each lead. [raw_row_id]"""
    df = propensity_percentile(df)
    points, reasons = conversation_component()
    now = F.lit(scoring_timestamp).cast("timestamp")
    df = df.withColumns({"lead_age_hours": age_hours(F.col("fecha_registro"), now), "conversation_component": points})
    df = df.withColumns({
        "sla_component": sla_component(F.col("lead_age_hours")), "availability_component": availability_component(F.col("is_available_at_store")),
        "propensity_component": propensity_component(F.col("propensity_percentile")),
    })
    total = F.col("conversation_component") + F.col("sla_component") + F.col("availability_component") + F.col("propensity_component")
    df = df.withColumn("priority_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2))
    step = lambda name, texts: F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])[F.col(name)]
    more = F.array_compact(F.array(step("sla_component", SLA_REASONS), step("availability_component", AVAILABILITY_REASONS), step("propensity_component", PROPENSITY_REASONS)))
    heat = F.when(F.col("priority_score") >= 60, "HOT").when(F.col("priority_score") >= 35, "WARM").otherwise("COLD")
    return df.withColumns({"temperature": heat, "priority_reasons": F.concat(reasons, more), "scoring_timestamp": now})


def queue_order() -> list[Column]:
    return [F.col("priority_score").desc(), F.col("fecha_registro").asc_nulls_last(), F.col("raw_row_id").asc()]


STORE = ["empresa_id", "punto_venta_id"]


def store_ranks(df: DataFrame) -> DataFrame:
    """{raw_row_id, empresa_id, punto_venta_id, store_priority_rank}: places within each store in queue order; a store may span many tasks."""
    slim = df.select("raw_row_id", "priority_score", "fecha_registro", *STORE)
    return group_rank(slim, [F.col(c) for c in STORE], queue_order(), "store_priority_rank").select("raw_row_id", *STORE, "store_priority_rank")


def add_ranks(df: DataFrame) -> DataFrame:
    """Ranks over all leads and within each store, in queue order. [raw_row_id]"""
    df = materialise(df, "to-rank")  # ranked twice, then joined
    everywhere = group_rank(df.select("raw_row_id", "priority_score", "fecha_registro"), [], queue_order(), "global_priority_rank")
    return df.join(everywhere.select("raw_row_id", "global_priority_rank"), "raw_row_id").join(store_ranks(df).drop(*STORE), "raw_row_id")


def assign_leads(df: DataFrame, advisors: DataFrame) -> DataFrame:
    """df with advisor_id and assignment_status, every lead in queue order going to the eligible advisor with
    the lowest share of capacity taken, then fewest leads, then smallest id. [raw_row_id]

    An advisor's k-th place is taken at share k / capacity, which only grows, so the whole sequence of a
    store's places is their order by (k / capacity, k, id): lead number n gets place number n. Companies
    and stores match null to null. Places beyond the number of a store's leads are not made. Leads that
    have their store_priority_rank keep it.
    """
    packed = [F.coalesce(c, F.lit("\u0000")).alias(f"_{c}") for c in STORE]
    ranked = df if "store_priority_rank" in df.columns else df.join(store_ranks(df).drop(*STORE), "raw_row_id")
    leads = ranked.select("*", F.col("store_priority_rank").alias("_no"), *packed)
    if ranked is not df:
        leads = leads.drop("store_priority_rank")
    size = leads.groupBy("_empresa_id", "_punto_venta_id").agg(F.count("*").alias("_leads"))
    active = advisors.where("activo").select("asesor_id", F.coalesce("capacidad_diaria_leads", F.lit(0)).alias("_cap"), *packed)
    room = active.join(size, ["_empresa_id", "_punto_venta_id"]).where("_cap > 0")
    slots = room.withColumn("_k", F.explode(F.sequence(F.lit(0), F.least("_cap", "_leads").cast("int") - 1)))
    places = slots.select("_empresa_id", "_punto_venta_id", "asesor_id", (F.col("_k") / F.col("_cap")).alias("_share"), "_k")
    order = [F.col("_share"), F.col("_k"), F.col("asesor_id")]
    slots = group_rank(places, [F.col("_empresa_id"), F.col("_punto_venta_id")], order, "_no").select("_empresa_id", "_punto_venta_id", "_no", F.col("asesor_id").alias("advisor_id"))
    some = active.select("_empresa_id", "_punto_venta_id").distinct().withColumn("_any", F.lit(True))
    out = leads.join(slots, ["_empresa_id", "_punto_venta_id", "_no"], "left").join(some, ["_empresa_id", "_punto_venta_id"], "left")
    status = F.when(F.col("advisor_id").isNotNull(), "ASSIGNED").when(F.col("_any"), "UNASSIGNED_CAPACITY").otherwise("NO_ELIGIBLE_ADVISOR")
    return out.withColumn("assignment_status", status).drop("_empresa_id", "_punto_venta_id", "_no", "_any")


def assignment_summary(assigned: DataFrame, advisors: DataFrame) -> DataFrame:
    """One row: counts by status and temperature, capacity used and there."""
    capacity = advisors.agg(F.coalesce(F.sum(F.when(F.col("activo"), F.col("capacidad_diaria_leads"))), F.lit(0)).alias("active_capacity"))
    n = lambda column, value: F.count_if(F.col(column) == value).alias(value.lower())
    counts = assigned.agg(F.count("*").alias("leads"), *[n("assignment_status", s) for s in ("ASSIGNED", "UNASSIGNED_CAPACITY", "NO_ELIGIBLE_ADVISOR")], *[n("temperature", t) for t in ("HOT", "WARM", "COLD")])
    return counts.join(F.broadcast(capacity)).withColumn("capacity_used", F.col("assigned"))
