"""Conversations: rendering, incremental plans, batches, reconciled answers, current extractions and lead features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.functions.text import normalize_evidence, strip_nul
from leadflow.operators.ranking import global_rank

MOST_FRAGMENTS, MOST_CHARACTERS = 5, 240
PAYMENTS, INTENTS = ("credito", "contado", "no_informa"), ("alta", "media", "baja", "indeterminada")
OBJECTIONS = ("precio", "cuota", "tasa", "disponibilidad", "modelo", "tiempo", "documentacion", "otra")


def render_conversation(messages: Column) -> Column:
    """`SPEAKER: text` lines in order; an error where a speaker or a text is missing."""
    broken = F.exists(messages, lambda m: m["emisor"].isNull() | m["texto"].isNull())
    lines = F.transform(messages, lambda m: F.concat(F.upper(strip_nul(m["emisor"])), F.lit(": "), strip_nul(m["texto"])))
    return F.when(broken, F.raise_error(F.lit("a message has no speaker or no text"))).otherwise(F.array_join(lines, "\n"))


def conversation_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def conversation_messages(stg: DataFrame) -> DataFrame:
    """One row per message, counted from 1."""
    rows = stg.select(
        F.col("conversacion_id").alias("conversation_id"), "lead_id", F.col("fecha_inicio").alias("conversation_started_at"),
        F.col("canal_normalizado").alias("conversation_channel"), F.posexplode("mensajes").alias("p", "m"),
    )
    return rows.select("conversation_id", "lead_id", "conversation_started_at", "conversation_channel", (F.col("p") + 1).alias("message_index"), F.col("m.hora").alias("message_time"), F.col("m.emisor").alias("speaker"), F.col("m.texto").alias("message_text"))


def plan_cases(cases: DataFrame, checkpoint: DataFrame, prompt_hash: str, contract: str, model: str, retry_errors: bool = False, force: bool = False) -> DataFrame:
    """cases {conversation_id, conversation_hash, ..} with plan_status: cached, skipped_error or pending.

    force runs cached cases again but does not retry failed ones; retry_errors does.
    """
    known = checkpoint.where((F.col("semantic_prompt_hash") == prompt_hash) & (F.col("batch_contract_version") == contract) & (F.col("model_requested") == model))
    last = known.groupBy("conversation_id", "conversation_hash").agg(F.max("status").alias("_status"))
    status = F.when((F.col("_status") == "SUCCESS") & F.lit(not force), "cached").when((F.col("_status") == "ERROR") & F.lit(not retry_errors), "skipped_error").otherwise("pending")
    return cases.join(last, ["conversation_id", "conversation_hash"], "left").withColumn("plan_status", status).drop("_status")


def assign_batches(cases: DataFrame, batch_size: int) -> DataFrame:
    """cases with batch_no (from 0): chunks of batch_size in the order of conversation_id."""
    if batch_size < 1:
        raise ValueError("batch_size must be 1 or more")
    ranked = global_rank(cases, [F.col("conversation_id").asc()], [], "_rank")
    return ranked.withColumn("batch_no", F.floor((F.col("_rank") - 1) / batch_size).cast("long")).drop("_rank")


def validation_error(payload: DataFrame) -> Column:
    """Whether a record breaks the contract: enums, amounts, and fragments of 1 to 240 characters."""
    c = F.col
    bad = ~c("forma_pago").isin(*PAYMENTS) | c("forma_pago").isNull() | ~c("intencion").isin(*INTENTS) | c("intencion").isNull() | ~F.coalesce(c("objecion_principal"), F.lit("otra")).isin(*OBJECTIONS)
    bad = bad | F.coalesce(c("presupuesto") < 0, F.lit(False)) | F.coalesce(c("cuota_inicial") < 0, F.lit(False))
    size = lambda e: F.length(F.trim(e["fragmento"]))
    return bad | F.exists("evidencia", lambda e: e["fragmento"].isNull() | (size(e) < 1) | (F.length(e["fragmento"]) > MOST_CHARACTERS)) | (F.size("evidencia") > MOST_FRAGMENTS)


def reconcile_responses(cases: DataFrame, responses: DataFrame) -> DataFrame:
    """One record per expected case: SUCCESS, or ERROR with duplicate_response_id, missing_response_id or
    structured_output_invalid (a response {conversation_id, valid} that is not valid). Unexpected ids are dropped."""
    seen = responses.groupBy("conversation_id").agg(F.count("*").alias("_n"), F.min("valid").alias("_valid"))
    error = F.when(F.col("_n").isNull(), "missing_response_id").when(F.col("_n") > 1, "duplicate_response_id").when(~F.coalesce("_valid", F.lit(False)), "structured_output_invalid")
    out = cases.join(seen, "conversation_id", "left").withColumn("error_type", error)
    return out.withColumn("status", F.when(F.col("error_type").isNull(), "SUCCESS").otherwise("ERROR")).drop("_n", "_valid")


def normalize_fragments(evidence: Column) -> Column:
    """Fragments that hold something, cut to 240 characters, the first five."""
    some = F.filter(evidence, lambda e: e.isNotNull() & (F.length(F.trim(F.coalesce(e["fragmento"], F.lit("")))) > 0))
    cut = F.transform(some, lambda e: F.struct(e["campo"].alias("campo"), F.substring(e["fragmento"], 1, MOST_CHARACTERS).alias("fragmento"), e["emisor"].alias("emisor")))
    return F.slice(cut, 1, MOST_FRAGMENTS)


def evidence_grounded(df: DataFrame, text: str = "conversation_text", evidence: str = "evidencia", name: str = "evidence_grounded") -> DataFrame:
    """df with whether every fragment occurs in the conversation, forms, case and white space aside; no fragment: true.

    The fragments are normalised as one text, kept apart by a private character."""
    apart = ""
    joined = normalize_evidence(F.array_join(F.transform(evidence, lambda e: e["fragmento"]), apart))
    out = df.withColumns({"_text": normalize_evidence(text), "_all": joined})
    ok = F.forall(F.split("_all", apart), lambda f: F.col("_text").contains(F.trim(f)))
    return out.withColumn(name, F.when(F.size(evidence) <= 0, True).otherwise(F.coalesce(ok, F.lit(False)))).drop("_text", "_all")


def current_extractions(log: DataFrame, conversations: DataFrame) -> DataFrame:
    """The latest successful extraction of each conversation, with its lead and start date. [conversation_id]"""
    # nulls come last when the latest is wanted; the smallest extraction_id breaks ties
    order = W.partitionBy("conversation_id").orderBy(F.col("processed_at").desc_nulls_last(), F.col("updated_at").desc_nulls_last(), F.col("extraction_id"))
    latest = log.where("status = 'SUCCESS'").drop("lead_id").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "status")
    started = conversations.select(F.col("conversacion_id").alias("conversation_id"), "lead_id", F.col("fecha_inicio").alias("conversation_started_at"))
    return latest.join(started, "conversation_id")


def orphan_conversations(current: DataFrame, leads: DataFrame) -> DataFrame:
    """Conversations without a lead, or of a lead that isn't there."""
    return current.join(leads.select("lead_id").distinct(), "lead_id", "left_anti").select("conversation_id", "lead_id", "conversation_started_at")


def lead_conversation_features(current: DataFrame, leads: DataFrame) -> DataFrame:
    """What is known of each lead from its conversations, the latest statement first. One grouping by lead_id."""
    linked = current.where("lead_id is not null").join(leads.select("lead_id").distinct(), "lead_id", "left_semi")
    when = F.struct("conversation_started_at", "conversation_id")  # Spark puts null dates first, so the maximum has them last
    latest = lambda value, test=None: F.max_by(F.when(value.isNotNull() if test is None else test, value), F.when(value.isNotNull() if test is None else test, when))
    c = F.col
    flag = lambda name: F.coalesce(c(name), F.lit(False))
    ids = F.array_sort(F.collect_list(F.struct(c("conversation_started_at").isNull().alias("none"), c("conversation_started_at").alias("at"), c("conversation_id").alias("id"))))
    return linked.groupBy("lead_id").agg(
        F.count("*").alias("conversation_count"), F.transform(ids, lambda x: x["id"]).alias("conversation_ids"),
        F.min("conversation_started_at").alias("first_conversation_at"), F.max("conversation_started_at").alias("latest_conversation_at"), F.max_by("conversation_id", when).alias("latest_conversation_id"),
        latest(c("modelo_interes")).alias("modelo_interes"), latest(c("presupuesto")).alias("presupuesto"), latest(c("cuota_inicial")).alias("cuota_inicial"),
        F.coalesce(latest(c("forma_pago"), c("forma_pago").isin("credito", "contado")), F.lit("no_informa")).alias("forma_pago"),
        F.coalesce(latest(c("intencion"), c("intencion") != "indeterminada"), F.lit("indeterminada")).alias("intencion"),
        latest(c("objecion_principal")).alias("objecion_principal"),
        F.bool_or(flag("pidio_cita")).alias("pidio_cita"), F.bool_or(flag("pidio_cotizacion")).alias("pidio_cotizacion"),
        F.bool_and(flag("evidence_grounded")).alias("conversation_evidence_grounded_all"),
        F.count_if(c("evidence_grounded")).alias("conversation_evidence_grounded_count"), F.count_if(~c("evidence_grounded")).alias("conversation_evidence_not_grounded_count"),
    )
