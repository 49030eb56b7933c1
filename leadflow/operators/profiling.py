"""Profile of the raw tables: {section, metric, key, value}."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions import text as T
from leadflow.functions.dates import date_format_label, date_status
from leadflow.plans.session import materialise


def _keys(df: DataFrame, **kinds: Column) -> DataFrame:
    """{kind, key, part, n}: how many rows of df have each key of each kind, in one pass. A kind is a column, or a struct of a key
    and a part of it; rows without a key count for nothing."""
    pairs = []
    for kind, c in kinds.items():
        key, part = c if isinstance(c, tuple) else (c, F.lit(None))
        pairs.append(F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), part.cast("string").alias("part")))
    each = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").where("key is not null")
    return materialise(each.groupBy("kind", "key", "part").agg(F.count(F.lit(1)).alias("n")), "profile-keys")


def _rows(section: str, metric: Column, key: Column, value: Column) -> list[Column]:
    return [F.lit(section).alias("section"), metric.alias("metric"), key.alias("key"), value.cast("double").alias("value")]


def _measures(section: str, df: DataFrame, **measures: Column) -> DataFrame:
    """One row of df's measures as a row each."""
    row = df.agg(*[F.coalesce(m.cast("double"), F.lit(0.0)).alias(n) for n, m in measures.items()])
    return row.unpivot([], list(measures), "metric", "value").select(*_rows(section, F.col("metric"), F.lit(""), F.col("value")))


def _counts(section: str, keys: DataFrame, *kinds: str) -> DataFrame:
    return keys.where(F.col("kind").isin(*kinds)).select(*_rows(section, F.col("kind"), F.col("key"), F.col("n")))


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def profile(leads: DataFrame, conversations: DataFrame, catalog: DataFrame, advisors: DataFrame, history: DataFrame) -> DataFrame:
    """Counts, distinct ids, nulls, value and format counts, phones shared within and across companies, orphans and outcomes.
    Each table is read once: what is counted is first put together by key, and the measures are taken from these counts."""
    c, blank = F.col, F.lit("")
    text = [f.name for f in leads.schema.fields if f.dataType.typeName() in ("string", "long", "integer", "double")]
    phone = F.when(c("telefono").isNotNull() & (F.trim("telefono") != ""), T.profile_phone(c("telefono")))
    known = lambda v: F.coalesce(v, blank)
    nulls = {f"nulls {n}": F.when(c(n).isNull() | (F.trim(c(n).cast("string")) == ""), F.lit(n)) for n in text}
    seen = _keys(
        leads, rows=blank, id=known(c("lead_id")), city=T.profile_city(c("ciudad")), phone=(phone, F.coalesce("empresa_id", blank)), invalid=F.when(~phone.startswith("+57"), blank),
        model=T.profile_model(c("modelo_interes_texto")), channel=known(T.channel(c("canal"))), state=known(T.management_state(c("estado_gestion"))),
        date_format=date_format_label(c("fecha_registro")), date_status=date_status(c("fecha_registro")), **nulls,
    )
    things = _keys(catalog, rows=blank, brand=c("marca"), name=T.profile_model(F.concat_ws(" ", "marca", "linea")))
    outcomes = _keys(history, outcome=known(T.normalize_text(c("desenlace"))))
    told = conversations.groupBy("lead_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("mensajes")).alias("messages"))
    ids = seen.where(_is("id"))
    told = materialise(told.join(ids.select(c("key").alias("lead_id"), F.lit(True).alias("there")), "lead_id", "left"), "profile-conversations")

    by_key = seen.where(_is("phone")).groupBy("key").agg(F.sum("n").alias("n"), F.count_if(c("part") != "").alias("companies"))
    empty = leads.sparkSession.createDataFrame([(n,) for n in text], "key string")
    counted = seen.where(c("kind").startswith("nulls ")).select("key", "n")
    total, done = F.sum(F.when(_is("rows"), c("n"))), F.sum(F.when(c("key").isin("cerrado", "perdido"), c("n")))
    closed, every = F.sum(F.when(c("key") == "cerrado", c("n"))), F.sum("n")
    active = T.yes_no(c("activo"))
    parts = [
        _measures("leads", seen, rows=total, distinct_ids=F.count_if(_is("id") & (c("key") != "")), invalid_phones=F.sum(F.when(_is("invalid"), c("n"))), cities=F.count_if(_is("city")), duplicate_ids=F.count_if(_is("id") & (c("n") > 1))),
        _measures("leads", seen.where(_is("model")).join(things.where(_is("name")).select("key"), "key", "left_semi"), exact_catalog_hits=F.sum("n")),
        _measures("phones", by_key, duplicate_groups_global=F.count_if(c("n") > 1), duplicate_groups_cross_company=F.count_if(c("companies") > 1)),
        _measures("phones", seen.where(_is("phone")), duplicate_groups_within_company=F.count_if(c("n") > 1)),
        empty.join(counted, "key", "left").select(*_rows("leads", F.lit("nulls"), c("key"), F.coalesce("n", F.lit(0)))),
        _counts("leads", seen, "channel", "state", "date_format", "date_status"),
        _measures("conversations", told, rows=every, average_messages=F.round(F.sum("messages") / every, 4), orphans=F.sum(F.when(c("there").isNull(), c("n"))), leads_with_several=F.count_if((c("n") > 1) & c("lead_id").isNotNull())),
        _measures("catalog", things, rows=total, brands=F.count_if(_is("brand"))),
        _measures("advisors", advisors, active=F.count_if(active), inactive=F.count_if(~active), active_capacity=F.sum(F.when(active, T.safe_integer(c("capacidad_diaria_leads"))))),
        _measures("history", outcomes, rows=every, close_rate=F.round(closed / every, 6), close_rate_managed=F.round(closed / done, 6)),
        _counts("history", outcomes, "outcome"),
    ]
    return reduce(DataFrame.unionByName, parts)
