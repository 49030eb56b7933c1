"""The driver's tables as the domain's: dirty leads, catalogue, advisors, history, conversations and extractions.

Each is SQL that Spark and DuckDB both read, so that the queries and their oracles begin with the same
rows. {orders} and the like stand for the tables. Only whole numbers and strings are computed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = "'2001-09-01'"
#: Leads that the source is known to hold twice: every 97th key takes the id of the next one.
KNOWN_DUPLICATES = ("L000000098", "L000000195", "L000000292")
KNOWN_LEAD = "L000000151"

LEADS = """
SELECT lpad(cast(k AS string), 10, '0') AS raw_row_id,
  concat('L', lpad(cast(CASE WHEN k % 97 = 0 THEN k + 1 ELSE k END AS string), 9, '0')) AS lead_id,
  CASE k % 7 WHEN 0 THEN d WHEN 1 THEN concat(dd, '-', mm, '-', yy) WHEN 2 THEN concat(dd, '/', mm, '/', yy) WHEN 3 THEN concat(mm, '/', dd, '/', yy, ' 10:30')
    WHEN 4 THEN concat(d, ' 08:15:00') WHEN 5 THEN CASE WHEN k % 5 = 0 THEN '2026-02-30' WHEN k % 5 = 1 THEN ' ' WHEN k % 5 = 2 THEN '31-04-2026' WHEN k % 5 = 3 THEN CASE WHEN k % 2 = 0 THEN '13/01/2026T10:00' ELSE '0/5/2026' END ELSE d END ELSE concat(d, 'T00:00:00Z') END AS fecha_registro,
  CASE k % 6 WHEN 0 THEN 'WhatsApp' WHEN 1 THEN ' Meta  Ads ' WHEN 2 THEN 'Formulario Web' WHEN 3 THEN 'whatsapp' WHEN 4 THEN 'Radio' END AS canal,
  CASE WHEN k % 53 = 0 THEN NULL ELSE concat('E', cast(n_regionkey AS string)) END AS empresa_id,
  concat('PV-', lpad(cast(n_nationkey AS string), 3, '0')) AS punto_venta_id,
  c_name AS nombre_cliente,
  CASE WHEN k % 3 = 0 THEN NULL WHEN k % 41 = 1 THEN '12345' WHEN k % 101 = 5 THEN '300 999 8877' ELSE concat(CASE k % 5 WHEN 0 THEN '+57 ' WHEN 1 THEN '0057-' WHEN 2 THEN '57' ELSE '' END, '3', lpad(cast(c % 1000 AS string), 4, '0'), ' ', lpad(cast(c AS string), 5, '0')) END AS telefono,
  CASE WHEN k % 4 = 1 THEN concat(' Cliente', cast(c AS string), '@Correo.co') WHEN k % 11 = 3 THEN 'test@test.com' WHEN k % 13 = 5 THEN 'prueba@x.co' WHEN k % 17 = 4 THEN 'sin correo' END AS email,
  CASE k % 8 WHEN 0 THEN 'Bogotá D.C.' WHEN 1 THEN ' MEDELLÍN ' WHEN 2 THEN 'B/quilla' WHEN 3 THEN 'Sta Marta' WHEN 4 THEN 'Itagüí' WHEN 5 THEN 'Rio  Negro' WHEN 6 THEN 'Lima' END AS ciudad,
  CASE WHEN p_name IS NULL OR k % 19 = 7 THEN NULL WHEN k % 5 = 0 THEN concat(upper(p_brand), ' ', p_name) WHEN k % 5 = 1 THEN concat(p_brand, '  ', p_name, ' 2026') WHEN k % 5 = 2 THEN p_name WHEN k % 5 = 3 THEN concat(p_brand, ' ', replace(p_name, 'o', '')) ELSE p_brand END AS modelo_interes_texto,
  CASE k % 9 WHEN 0 THEN 'Sin gestión' WHEN 1 THEN 'CONTACTADO' WHEN 2 THEN 'No contesta' WHEN 3 THEN 'Cotización enviada' WHEN 4 THEN 'En proceso' WHEN 5 THEN 'Descartado' WHEN 6 THEN 'Otro' END AS estado_gestion,
  CASE WHEN k % 4 = 2 THEN d WHEN k % 4 = 3 THEN concat(dd, '.', mm, '.', yy) END AS fecha_primer_contacto,
  CASE WHEN k % 10 < 3 THEN ' Campaña ' END AS campania
FROM (SELECT o_orderkey AS k, c_custkey AS c, n_regionkey, n_nationkey, c_name, p_brand, p_name, substr(cast(o_orderdate AS string), 1, 10) AS d,
    substr(cast(o_orderdate AS string), 1, 4) AS yy, substr(cast(o_orderdate AS string), 6, 2) AS mm, substr(cast(o_orderdate AS string), 9, 2) AS dd
  FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey CROSS JOIN (SELECT count(*) AS parts FROM {part}) AS pc LEFT JOIN {part} ON p_partkey = o_orderkey % parts) AS b
"""

#: Every 40th entry is there twice, in other letters.
CATALOG = """
SELECT sku, marca, linea, CASE WHEN k % 5 = 0 THEN ' 125 ' WHEN k % 5 = 1 THEN '125cc' WHEN k % 5 = 2 THEN '' ELSE '200' END AS cilindraje, CASE WHEN k % 2 = 0 THEN ' Scooter' ELSE 'Económica' END AS segmento,
  concat(cast(100 + k AS string), CASE WHEN k % 3 = 0 THEN '.50' WHEN k % 7 = 0 THEN ',00' ELSE '' END) AS precio_lista,
  concat('PV-', lpad(cast(k % 25 AS string), 3, '0'), '| PV-', lpad(cast((k + 7) % 25 AS string), 3, '0'), '||PV-', lpad(cast(k % 25 AS string), 3, '0')) AS puntos_venta_disponibles,
  CASE WHEN k % 4 = 0 THEN 'x' ELSE cast(k % 9 AS string) END AS unidades_disponibles
FROM (SELECT lpad(cast(min(p_partkey) AS string), 8, '0') AS sku, p_brand AS marca, p_name AS linea, min(p_partkey) AS k FROM {part} GROUP BY p_brand, p_name
  UNION ALL SELECT concat('9', lpad(cast(min(p_partkey) AS string), 7, '0')), upper(p_brand), replace(p_name, ' ', '-'), min(p_partkey) + 1 FROM {part} GROUP BY p_brand, p_name HAVING min(p_partkey) % 40 = 0) AS c
"""

ADVISORS = """
SELECT concat('A', lpad(cast(s_suppkey AS string), 6, '0')) AS asesor_id, s_name AS nombre, concat('PV-', lpad(cast(n_nationkey AS string), 3, '0')) AS punto_venta_id,
  CASE WHEN s_suppkey % 31 = 30 THEN 'E9' ELSE concat('E', cast(n_regionkey AS string)) END AS empresa_id,
  CASE WHEN s_suppkey % 13 = 12 THEN 'muchos' WHEN s_suppkey % 17 = 16 THEN ' ' ELSE cast(s_suppkey % 25 AS string) END AS capacidad_diaria_leads,
  CASE s_suppkey % 7 WHEN 5 THEN 'No' WHEN 6 THEN ' ' WHEN 4 THEN 'Sí' ELSE 'SI' END AS activo, '2020-01-15' AS fecha_ingreso
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
"""

HISTORY = """
SELECT concat(lpad(cast(l_orderkey AS string), 10, '0'), '-', cast(l_linenumber AS string)) AS raw_row_id, concat('H', cast(l_orderkey AS string)) AS lead_id,
  substr(cast(l_shipdate AS string), 1, 10) AS fecha_registro, CASE l_partkey % 4 WHEN 0 THEN 'WhatsApp' WHEN 1 THEN 'Meta Ads' WHEN 2 THEN 'formulario web' END AS canal,
  concat('E', cast(l_suppkey % 5 AS string)) AS empresa_id, concat('PV-', lpad(cast(l_suppkey % 25 AS string), 3, '0')) AS punto_venta_id,
  concat('Modelo ', cast(l_partkey % 12 AS string)) AS modelo_cotizado, CASE WHEN l_partkey % 9 = 0 THEN 'n/d' ELSE concat(cast(l_partkey % 500 + 100 AS string), '.25') END AS precio_lista,
  CASE WHEN l_linenumber % 3 = 0 THEN '2.5' ELSE cast(l_linenumber AS string) END AS horas_al_primer_contacto, cast(l_linenumber AS string) AS numero_contactos,
  CASE WHEN l_orderkey % 3 = 0 THEN 'Sí' WHEN l_orderkey % 3 = 1 THEN 'no' END AS manifesto_cuota_inicial, CASE WHEN l_orderkey % 2 = 0 THEN ' Crédito' ELSE 'contado' END AS forma_pago_declarada,
  CASE WHEN l_partkey % 2 = 0 THEN 'si' ELSE 'NO' END AS pidio_cita, CASE l_returnflag WHEN 'R' THEN 'Cerrado' WHEN 'A' THEN 'Perdido' ELSE 'Sin gestión' END AS desenlace
FROM {lineitem}
"""

#: One row per message: the given role and text, or a commercial phrase chosen by conversation and turn.
TURNS = """
SELECT concat('C', lpad(cast(conv_id AS string), 7, '0')) AS conversacion_id, conv_id, turn, CASE role WHEN 'user' THEN 'cliente' WHEN 'assistant' THEN 'asesor' ELSE 'sistema' END AS emisor,
  concat(text, CASE (conv_id + turn * 3) % 10 WHEN 0 THEN ' financiada, tengo 2000 mil de inicial' WHEN 1 THEN ' de contado, 6 palos' WHEN 2 THEN ' le envio una cotizacion' WHEN 3 THEN ' mandela'
    WHEN 4 THEN ' era por curiosidad' WHEN 5 THEN ' puedo pasar hoy' WHEN 6 THEN ' presupuesto 1.500.000' ELSE '' END) AS texto, concat('10:', lpad(cast(turn % 60 AS string), 2, '0')) AS hora
FROM {conversations}
"""

CONVERSATION_HEADS = """
SELECT concat('C', lpad(cast(conv_id AS string), 7, '0')) AS conversacion_id,
  CASE WHEN conv_id % 11 = 0 THEN NULL WHEN conv_id % 13 = 0 THEN 'L-none' ELSE concat('L', lpad(cast(conv_id - conv_id % 3 + 1 AS string), 9, '0')) END AS lead_id,
  CASE conv_id % 3 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'Meta Ads' ELSE 'teléfono' END AS canal,
  CASE WHEN conv_id % 7 = 0 THEN '' ELSE concat('2026-0', cast(conv_id % 9 + 1 AS string), '-1', cast(conv_id % 10 AS string)) END AS fecha_inicio
FROM (SELECT DISTINCT conv_id FROM {conversations}) AS c
"""

EXTRACTIONS = """
SELECT concat('X', cast(conv_id AS string), '-', cast(a AS string)) AS extraction_id, concat('C', lpad(cast(conv_id AS string), 7, '0')) AS conversation_id, concat('h', cast(conv_id % 50 AS string)) AS conversation_hash,
  CASE WHEN (conv_id + a) % 3 = 0 THEN 'p1' ELSE 'p2' END AS semantic_prompt_hash, 'v1' AS batch_contract_version, CASE WHEN a = 2 THEN 'm2' ELSE 'm1' END AS model_requested,
  CASE WHEN (conv_id * 7 + a) % 5 = 0 THEN 'ERROR' ELSE 'SUCCESS' END AS status,
  CASE WHEN (conv_id + a) % 4 = 0 THEN NULL ELSE concat('Modelo ', cast(conv_id % 6 AS string)) END AS modelo_interes,
  CASE WHEN (conv_id + a) % 3 = 1 THEN cast((conv_id % 9 + 1) * 500000 AS double) END AS presupuesto, CASE WHEN (conv_id + a) % 5 = 1 THEN cast(conv_id % 4 * 250000 AS double) END AS cuota_inicial,
  CASE (conv_id + a) % 3 WHEN 0 THEN 'credito' WHEN 1 THEN 'contado' ELSE 'no_informa' END AS forma_pago, CASE (conv_id + a) % 4 WHEN 0 THEN 'alta' WHEN 1 THEN 'media' WHEN 2 THEN 'baja' ELSE 'indeterminada' END AS intencion,
  CASE WHEN conv_id % 3 = 0 THEN 'precio' WHEN conv_id % 3 = 1 THEN 'tiempo' END AS objecion_principal, (conv_id + a) % 2 = 0 AS pidio_cita, CASE WHEN conv_id % 6 = 5 THEN NULL ELSE (conv_id + a) % 3 = 0 END AS pidio_cotizacion,
  CASE WHEN conv_id % 8 = 7 THEN NULL ELSE (conv_id + a) % 5 <> 0 END AS evidence_grounded, CASE WHEN (conv_id + a) % 6 = 0 THEN NULL ELSE concat('2026-03-0', cast((conv_id + a) % 3 + 1 AS string)) END AS processed_at,
  CASE WHEN a = 0 THEN NULL ELSE concat('2026-04-0', cast(conv_id % 2 + 1 AS string)) END AS updated_at,
  CASE WHEN (conv_id * 7 + a) % 5 = 0 THEN CASE conv_id % 4 WHEN 0 THEN 'structured_output_invalid' WHEN 1 THEN 'rate_limit' WHEN 2 THEN '' END END AS error_type, cast((conv_id * 13 + a * 7) % 40 AS double) / 8 AS latency_seconds
FROM (SELECT DISTINCT conv_id, turn % 3 AS a FROM {conversations}) AS t
"""

#: Labels as reviewers type them.
REVIEWS = f"""
SELECT conversation_id, extraction_id AS conversation_text, concat(' ', modelo_interes, ' ') AS modelo_interes, CASE WHEN presupuesto IS NULL THEN ' ' ELSE concat(cast(cast(presupuesto AS bigint) AS string), '.5') END AS presupuesto,
  CASE WHEN cuota_inicial IS NULL THEN 'n/d' ELSE cast(cast(cuota_inicial AS bigint) AS string) END AS cuota_inicial, concat(forma_pago, ' ') AS forma_pago, intencion, coalesce(objecion_principal, '') AS objecion_principal,
  CASE WHEN pidio_cita THEN 'TRUE' ELSE ' False ' END AS pidio_cita, CASE WHEN pidio_cotizacion THEN 'true' WHEN NOT pidio_cotizacion THEN '' ELSE 'yes' END AS pidio_cotizacion,
  CASE WHEN extraction_id LIKE '%1' THEN ' True' WHEN extraction_id LIKE '%2' THEN 'false' WHEN extraction_id LIKE '%0' THEN 'TRUE ' END AS reviewed
FROM ({EXTRACTIONS}) AS x
"""

SCORES = """
SELECT lpad(cast(o_orderkey AS string), 10, '0') AS raw_row_id, CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE cast(o_orderkey * 37 % 1000 AS double) / 1000 END AS propensity_score FROM {orders}
"""

EVENTS = """
SELECT event_id, lpad(cast(event_id - event_id % 4 + 1 AS string), 10, '0') AS raw_row_id, event_type, event_id % 3 <> 0 AS responded, substr(cast(ts AS string), 1, 19) AS at, user_id FROM {events}
"""

HELP = """
SELECT concat('doc', lpad(cast(doc_id AS string), 8, '0')) AS stem, concat('Intro ', source, chr(10), '# Title ', cast(doc_id AS string), chr(10), substr(text, 1, instr(text, chr(10))), '## Part', chr(10), substr(text, instr(text, chr(10)) + 1)) AS text
FROM {documents} WHERE doc_id IS NOT NULL
"""

#: Damage for the checks: new values of columns, in SQL that both engines read, by table.
DAMAGE = {
    "stg_leads": {"raw_row_id": "CASE WHEN raw_row_id = '0000000050' THEN '0000000051' ELSE raw_row_id END", "punto_venta_id": "CASE WHEN raw_row_id LIKE '%07' THEN 'PV-7' ELSE punto_venta_id END"},
    "stg_asesores": {"capacidad_diaria_leads": "CASE WHEN asesor_id LIKE '%3' THEN -1 WHEN asesor_id LIKE '%4' THEN 1 ELSE capacidad_diaria_leads END", "activo": "CASE WHEN asesor_id LIKE '%2' THEN false ELSE activo END"},
    "stg_catalogo_motos": {"unidades_disponibles": "CASE WHEN sku LIKE '%11' THEN -1 ELSE unidades_disponibles END"},
    "stg_historico_cierres": {"is_closed": "CASE WHEN raw_row_id LIKE '%00-1' THEN NULL ELSE is_closed END"},
    "lead_identity_map": {"customer_identity_id": "CASE WHEN raw_row_id LIKE '%1' THEN 'CID_shared' WHEN raw_row_id LIKE '%32' THEN concat('CID_', raw_row_id) ELSE customer_identity_id END"},
    "lead_model_match": {"sku": "CASE WHEN raw_row_id LIKE '%15' THEN NULL ELSE sku END", "match_score": "CASE WHEN raw_row_id LIKE '%16' THEN 1.5 ELSE match_score END"},
    "leads_enriched": {"raw_row_id": "CASE WHEN raw_row_id = '0000000060' THEN '0000000061' ELSE raw_row_id END", "lead_id": "CASE WHEN raw_row_id LIKE '%00098' THEN 'L-other' ELSE lead_id END", "empresa_id": "CASE WHEN raw_row_id LIKE '%44' THEN 'E8' ELSE empresa_id END", "precio_lista": "CASE WHEN raw_row_id LIKE '%18' THEN NULL ELSE precio_lista END"},
    "lead_conversation_features": {"conversation_count": "CASE WHEN lead_id LIKE '%4' THEN 0 ELSE conversation_count END"},
    "assignments": {"advisor_id": "CASE WHEN advisor_id LIKE '%5' THEN 'A-unknown' ELSE advisor_id END", "priority_score": "CASE WHEN raw_row_id LIKE '%21' THEN 120.0 WHEN raw_row_id LIKE '%22' THEN -1.0 ELSE priority_score END", "punto_venta_id": "CASE WHEN raw_row_id LIKE '%23' THEN NULL ELSE punto_venta_id END"},
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


def load(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the statements above."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used)


def damaged(df: DataFrame, name: str) -> DataFrame:
    """df with the damage of a table."""
    return df.withColumns({c: F.expr(e).cast(df.schema[c].dataType) for c, e in DAMAGE[name].items()})


def duckdb(sql: str) -> str:
    """The same statement over views of the tables."""
    return reduce(lambda s, t: s.replace("{" + t + "}", t), TABLES, sql).strip()
