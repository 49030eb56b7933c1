"""Staging tables: row-local projections of raw text columns, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions import text as T
from leadflow.functions.dates import date_status, date_value

LINEAGE = ("raw_row_id", "ingestion_file_id", "source_row_number", "raw_payload", "loaded_at")


def _lineage(raw: DataFrame) -> list[Column]:
    return [F.col(c) for c in LINEAGE if c in raw.columns]


def _dated(name: str, source: str | None = None) -> list[Column]:
    c = T.blank_to_null(F.col(source or name))
    return [c.alias(f"{name}_raw"), date_value(c).alias(name), date_status(c).alias(f"{name}_parse_status")]


def stg_leads(raw: DataFrame) -> DataFrame:
    """raw leads -> one row per raw_row_id: raw and normalised channel, state, city, phone, email, model and dates."""
    b = lambda c: T.blank_to_null(F.col(c))
    return raw.select(
        *_lineage(raw), "lead_id", "empresa_id", "punto_venta_id", "nombre_cliente",
        b("canal").alias("canal_raw"), T.channel(b("canal")).alias("canal_normalizado"),
        b("estado_gestion").alias("estado_gestion_raw"), T.management_state(b("estado_gestion")).alias("estado_gestion_normalizado"),
        b("ciudad").alias("ciudad_raw"), T.city(b("ciudad")).alias("ciudad_normalizada"),
        b("telefono").alias("telefono_raw"), T.phone_normalized(b("telefono")).alias("telefono_normalizado"), T.phone_status(b("telefono")).alias("telefono_parse_status"),
        b("email").alias("email_raw"), T.normalize_text(b("email")).alias("email_normalizado"),
        b("modelo_interes_texto").alias("modelo_interes_raw"), F.nullif(T.normalize_lexical(b("modelo_interes_texto")), F.lit("")).alias("modelo_interes_normalizado"),
        *_dated("fecha_registro"), *_dated("fecha_primer_contacto"),
        b("campania").alias("campania_raw"), b("campania").alias("campania_normalizada"),
    )


def stg_conversations(raw: DataFrame) -> DataFrame:
    c = T.blank_to_null(F.col("canal"))
    return raw.select(*_lineage(raw), "conversacion_id", "lead_id", c.alias("canal_raw"), T.channel(c).alias("canal_normalizado"), *_dated("fecha_inicio"), "mensajes")


def stg_catalogo_motos(raw: DataFrame) -> DataFrame:
    b = lambda c: T.blank_to_null(F.col(c))
    both = F.concat(F.coalesce("marca", F.lit("")), F.lit(" "), F.coalesce("linea", F.lit("")))
    return raw.select(
        *_lineage(raw), "sku",
        b("marca").alias("marca_raw"), F.nullif(T.normalize_text(F.col("marca")), F.lit("")).alias("marca_normalizada"),
        b("linea").alias("linea_raw"), F.nullif(T.normalize_lexical(F.col("linea")), F.lit("")).alias("linea_normalizada"),
        T.canonical_model(F.col("marca"), F.col("linea")).alias("modelo_canonico"), F.nullif(T.normalize_lexical(both), F.lit("")).alias("modelo_normalizado"),
        b("cilindraje").alias("cilindraje_raw"), T.safe_integer(F.col("cilindraje")).alias("cilindraje"), T.number_status(F.col("cilindraje")).alias("cilindraje_parse_status"),
        b("segmento").alias("segmento_raw"), F.nullif(T.normalize_text(F.col("segmento")), F.lit("")).alias("segmento_normalizado"),
        b("precio_lista").alias("precio_lista_raw"), T.safe_decimal(F.col("precio_lista")).alias("precio_lista"), T.number_status(F.col("precio_lista"), decimal=True).alias("precio_lista_parse_status"),
        b("puntos_venta_disponibles").alias("puntos_venta_disponibles_raw"),
        b("unidades_disponibles").alias("unidades_disponibles_raw"), T.safe_integer(F.col("unidades_disponibles")).alias("unidades_disponibles"), T.number_status(F.col("unidades_disponibles")).alias("unidades_disponibles_parse_status"),
    )


def stg_asesores(raw: DataFrame) -> DataFrame:
    """raw advisors -> one row per asesor_id, which must be unique."""
    b = lambda c: T.blank_to_null(F.col(c))
    return raw.select(
        *_lineage(raw), "asesor_id", "nombre", "punto_venta_id", "empresa_id",
        b("capacidad_diaria_leads").alias("capacidad_diaria_leads_raw"), T.safe_integer(F.col("capacidad_diaria_leads")).alias("capacidad_diaria_leads"), T.number_status(F.col("capacidad_diaria_leads")).alias("capacidad_diaria_leads_parse_status"),
        b("activo").alias("activo_raw"), T.yes_no(F.col("activo")).alias("activo"), T.yes_no_status(F.col("activo")).alias("activo_parse_status"), *_dated("fecha_ingreso"),
    )


def stg_historico_cierres(raw: DataFrame) -> DataFrame:
    b = lambda c: T.blank_to_null(F.col(c))
    n = lambda c: F.nullif(T.normalize_text(F.col(c)), F.lit(""))
    return raw.select(
        *_lineage(raw), "lead_id", *_dated("fecha_registro"),
        b("canal").alias("canal_raw"), T.channel(F.col("canal")).alias("canal_normalizado"), "empresa_id", "punto_venta_id",
        b("modelo_cotizado").alias("modelo_cotizado_raw"), F.nullif(T.normalize_lexical(F.col("modelo_cotizado")), F.lit("")).alias("modelo_cotizado_normalizado"),
        b("precio_lista").alias("precio_lista_raw"), T.safe_decimal(F.col("precio_lista")).alias("precio_lista"),
        b("horas_al_primer_contacto").alias("horas_al_primer_contacto_raw"), T.safe_decimal(F.col("horas_al_primer_contacto")).alias("horas_al_primer_contacto"),
        b("numero_contactos").alias("numero_contactos_raw"), T.safe_integer(F.col("numero_contactos")).alias("numero_contactos"),
        b("forma_pago_declarada").alias("forma_pago_declarada_raw"), n("forma_pago_declarada").alias("forma_pago_declarada_normalizada"),
        b("manifesto_cuota_inicial").alias("manifesto_cuota_inicial_raw"), T.yes_no(F.col("manifesto_cuota_inicial")).alias("manifesto_cuota_inicial"),
        b("pidio_cita").alias("pidio_cita_raw"), T.yes_no(F.col("pidio_cita")).alias("pidio_cita"),
        b("desenlace").alias("desenlace_raw"), n("desenlace").alias("desenlace_normalizado"), T.is_closed(F.col("desenlace")).alias("is_closed"),
    )


def invalid_leads(stg: DataFrame) -> DataFrame:
    """Quarantine: an invalid phone or date, or a channel or state that is given but not known."""
    bad = [F.col(f"{c}_parse_status") == "INVALID" for c in ("telefono", "fecha_registro", "fecha_primer_contacto")]
    unknown = [F.col(f"{c}_normalizado").isNull() & F.col(f"{c}_raw").isNotNull() for c in ("canal", "estado_gestion")]
    test = bad[0]
    for t in [*bad[1:], *unknown]:
        test = test | t
    return stg.where(test)
