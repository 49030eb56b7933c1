"""Marts: one row per lead, first with identity and model, then with what conversations tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def leads_enriched(leads: DataFrame, identity: DataFrame, match: DataFrame) -> DataFrame:
    """Left joins on raw_row_id; the grain of leads stays."""
    who = identity.select("raw_row_id", "customer_identity_id", "identity_member_count", "is_duplicate_identity", "has_multiple_channels")
    what = match.select("raw_row_id", "sku", "modelo_canonico", "marca_normalizada", "linea_normalizada", "precio_lista", "match_method", "match_score", "match_status", "is_available_at_store")
    out = leads.drop("raw_payload").join(who, "raw_row_id", "left").join(what, "raw_row_id", "left")
    return out.withColumns({
        "has_valid_phone": F.col("telefono_parse_status") == "VALID",
        "has_resolved_model": F.col("match_status") == "MATCHED",
        "has_ambiguous_registration_date": F.col("fecha_registro_parse_status") == "AMBIGUOUS",
    })


def leads_ai_enriched(enriched: DataFrame, features: DataFrame) -> DataFrame:
    renamed = ("modelo_interes", "presupuesto", "cuota_inicial", "forma_pago", "intencion", "objecion_principal", "pidio_cita", "pidio_cotizacion")
    f = features.select(
        "lead_id", F.col("conversation_count").alias("_n"), "conversation_ids", "first_conversation_at", "latest_conversation_at", "latest_conversation_id",
        *[F.col(c).alias(f"conversation_{c}") for c in renamed],
        "conversation_evidence_grounded_all", "conversation_evidence_grounded_count", "conversation_evidence_not_grounded_count",
    )
    out = enriched.join(f, "lead_id", "left")
    there = F.col("_n").isNotNull()
    return out.withColumns({"has_conversation": there, "has_llm_extraction": there, "conversation_count": F.coalesce("_n", F.lit(0))}).drop("_n")
