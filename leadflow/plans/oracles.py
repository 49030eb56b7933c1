"""SQL for the registered queries, as named steps that are put together on demand."""

from __future__ import annotations

import re

from leadflow.functions import text as T
from leadflow.operators.identity import DUMMY_EMAILS
from leadflow.operators.propensity import LEAKAGE_AUDIT
from leadflow.plans import fixtures as X
from leadflow.sources.files import CONTRACTS


def nt(c: str) -> str:
    return f"lower(trim(regexp_replace(translate({c}, '{T.FOLDED_FROM}', '{T.FOLDED_TO}'), '\\s+', ' ', 'g')))"


def lex(c: str) -> str:
    return f"trim(regexp_replace({nt(c)}, '[^a-z0-9]+', ' ', 'g'))"


def model(c: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({c})), '[^a-z0-9]+', ' ', 'g'))"


def blank(c: str) -> str:
    return f"nullif(trim({c}), '')"


def mapped(c: str, table: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v if isinstance(v, bool) else repr(v)}" for k, v in table.items()) + " END"


def digits(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9]', '', 'g')"


def phone(c: str) -> str:
    return f"CASE WHEN regexp_extract({digits(c)}, '^(57|0057)?(3[0-9]{{9}})$', 2) <> '' THEN '+57' || regexp_extract({digits(c)}, '^(57|0057)?(3[0-9]{{9}})$', 2) END"


def phone_status(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'MISSING' WHEN regexp_matches({digits(c)}, '^(57|0057)?3[0-9]{{9}}$') THEN 'VALID' ELSE 'INVALID' END"


def _day(y: str, m: str, d: str) -> str:
    return f"try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"


SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})([ T].*)?$"


def date_any(c: str) -> str:
    g = lambda p, k: f"regexp_extract(trim({c}), '{p}', {k})"
    iso, dash = r"^(\d{4})-(\d{2})-(\d{2})([ T].*)?$", r"^(\d{2})-(\d{2})-(\d{4})$"
    return (
        f"CASE WHEN regexp_matches(trim({c}), '{iso}') THEN {_day(g(iso, 1), g(iso, 2), g(iso, 3))} WHEN regexp_matches(trim({c}), '{dash}') THEN {_day(g(dash, 3), g(dash, 2), g(dash, 1))} "
        f"WHEN regexp_matches(trim({c}), '{SLASH}') THEN CASE WHEN try_cast({g(SLASH, 1)} AS INT) > 12 THEN {_day(g(SLASH, 3), g(SLASH, 2), g(SLASH, 1))} ELSE {_day(g(SLASH, 3), g(SLASH, 1), g(SLASH, 2))} END END"
    )


def date_status(c: str) -> str:
    part = lambda k: f"try_cast(regexp_extract(trim({c}), '{SLASH}', {k}) AS INT) <= 12"
    return f"CASE WHEN {blank(c)} IS NULL THEN 'MISSING' WHEN regexp_matches(trim({c}), '{SLASH}') AND {part(1)} AND {part(2)} THEN 'AMBIGUOUS' WHEN ({date_any(c)}) IS NOT NULL THEN 'VALID' ELSE 'INVALID' END"


def dated(name: str) -> str:
    c = blank(name)
    return f"{c} AS {name}_raw, CASE WHEN ({date_status(c)}) = 'VALID' THEN {date_any(c)} END AS {name}, {date_status(c)} AS {name}_parse_status"


def integer(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '^[0-9]+$') THEN cast(trim({c}) AS INT) END"


def decimal(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '^[0-9]+(\\.[0-9]+)?$') THEN cast(trim({c}) AS DOUBLE) END"


def status(c: str, pattern: str = "^[0-9]+$") -> str:
    return f"CASE WHEN regexp_matches(trim({c}), '{pattern}') THEN 'VALID' WHEN {blank(c)} IS NULL THEN 'MISSING' ELSE 'INVALID' END"


def amount(c: str) -> str:
    p = r"(\d+(?:[.,]\d+)*)\s*(millones?|mm?|palos?|mil)?"
    n, s = f"regexp_extract({c}, '{p}', 1, 'i')", f"lower(regexp_extract({c}, '{p}', 2, 'i'))"
    plain = rf"CASE WHEN regexp_matches({n}, '^\d{{1,3}}([.,]\d{{3}})+$') THEN regexp_replace({n}, '[.,]', '', 'g') ELSE replace({n}, ',', '.') END"
    money = rf"(regexp_matches({c}, '{T.MONEY_WORDS}', 'i') OR regexp_matches({c}, '^\s*\$?\d{{1,3}}(?:[.,]\d{{3}})+\s*$'))"
    return f"CASE WHEN {money} THEN try_cast({plain} AS DOUBLE) * CASE WHEN {s} LIKE 'millon%' OR {s} LIKE 'palo%' THEN 1000000.0 WHEN {s} LIKE 'm%' THEN 1000.0 ELSE 1.0 END END"


def profile_city(c: str) -> str:
    v = f"replace({nt(c)}, '.', '')"
    aliases = {"bogota dc": "bogota", "bogota d c": "bogota", "cartagena de indias": "cartagena", "rio negro": "rionegro", "sta marta": "santa marta", "b/quilla": "barranquilla"}
    return f"coalesce({mapped(v, aliases)}, {v})"


def profile_model(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace({lex(c)}, '\\b2026\\b', '', 'g'), '\\s+', ' ', 'g'))"


def profile_phone(c: str) -> str:
    d = digits(c)
    local = f"CASE WHEN starts_with({d}, '0057') AND length({d}) = 14 THEN substr({d}, 5, 10) WHEN starts_with({d}, '57') AND length({d}) = 12 THEN substr({d}, 3, 10) ELSE {d} END"
    return f"CASE WHEN trim({c}) <> '' THEN CASE WHEN regexp_matches({local}, '^3[0-9]{{9}}$') THEN '+57' || ({local}) ELSE {local} END END"


YES = {"si": True, "no": False}
DECIMAL = r"^[0-9]+(\.[0-9]+)?$"

#: The damaged match is that of exact names and aliases, like the mart's.
DAMAGED_FROM = {"lead_model_match": "lead_model_match_exact"}


def _checks(rows: dict[str, str]) -> str:
    return "\nUNION ALL ".join(f"SELECT '{name}' AS \"check\", (SELECT count(*) FROM ({bad})) AS violations" for name, bad in rows.items())


def validation_sql(d: str) -> str:
    given, own = f"(SELECT * FROM {d}assignments WHERE assignment_status = 'ASSIGNED')", f"{d}stg_asesores"
    return _checks({
        "row_count_mismatch": f"SELECT 1 WHERE (SELECT count(*) FROM {d}assignments) <> (SELECT count(*) FROM leads_ai_enriched)",
        "scores_out_of_range": f"SELECT 1 FROM {d}assignments WHERE priority_score < 0 OR priority_score > 100",
        "inactive_assignments": f"SELECT 1 FROM {given} g LEFT JOIN {own} a ON a.asesor_id = g.advisor_id WHERE a.asesor_id IS NULL OR a.activo IS NOT TRUE",
        "advisors_over_capacity": f"SELECT g.advisor_id FROM {given} g JOIN {own} a ON a.asesor_id = g.advisor_id GROUP BY g.advisor_id, a.capacidad_diaria_leads HAVING count(*) > coalesce(a.capacidad_diaria_leads, 0)",
        "invalid_company_store_assignments": f"SELECT 1 FROM {given} g JOIN {own} a ON a.asesor_id = g.advisor_id WHERE g.empresa_id IS DISTINCT FROM a.empresa_id OR g.punto_venta_id IS DISTINCT FROM a.punto_venta_id",
    })


def day_sql(d: str) -> str:
    given = f"(SELECT g.*, a.empresa_id AS e, a.punto_venta_id AS p, a.activo, a.capacidad_diaria_leads AS cap FROM {d}assignments g LEFT JOIN {d}stg_asesores a ON a.asesor_id = g.advisor_id WHERE assignment_status = 'ASSIGNED')"
    return _checks({
        "rows_match_mart": f"SELECT 1 FROM (SELECT raw_row_id, count(*) AS n FROM {d}assignments GROUP BY 1) x FULL JOIN (SELECT raw_row_id, count(*) AS m FROM leads_ai_enriched GROUP BY 1) y USING (raw_row_id) WHERE coalesce(n, 0) <> coalesce(m, 0)",
        "score_out_of_range": f"SELECT 1 FROM {d}assignments WHERE (priority_score BETWEEN 0 AND 100) IS NOT TRUE",
        "inactive_or_missing_advisor": f"SELECT 1 FROM {given} WHERE activo IS NOT TRUE",
        "over_capacity": f"SELECT advisor_id FROM {given} GROUP BY advisor_id HAVING count(*) > coalesce(max(cap), 0)",
        "company_mismatch": f"SELECT 1 FROM {given} WHERE empresa_id IS DISTINCT FROM e",
        "store_mismatch": f"SELECT 1 FROM {given} WHERE punto_venta_id IS DISTINCT FROM p",
    })


def checks_sql(d: str) -> str:
    match = f"{d}lead_model_match" if d else "lead_model_match_exact"
    known = ", ".join(repr(x) for x in X.KNOWN_DUPLICATES)
    same = lambda a, b, test: f"SELECT 1 FROM (SELECT raw_row_id, count(*) AS n FROM {a} GROUP BY 1) x FULL JOIN (SELECT raw_row_id, count(*) AS m FROM {b} GROUP BY 1) y USING (raw_row_id) WHERE {test}"
    once, equal = "coalesce(n, 0) <> 1 OR coalesce(m, 0) <> 1", "coalesce(n, 0) <> coalesce(m, 0)"
    return _checks({
        "not_null:raw_row_id": f"SELECT 1 FROM {d}stg_leads WHERE raw_row_id IS NULL",
        "unique:lead_id": f"SELECT lead_id FROM {d}stg_leads GROUP BY 1 HAVING count(*) > 1",
        "accepted_values:canal_normalizado": f"SELECT 1 FROM {d}stg_leads WHERE canal_normalizado NOT IN ('whatsapp', 'meta_ads')",
        "relationships:lead_id": f"SELECT 1 FROM stg_conversations WHERE lead_id IS NOT NULL AND lead_id NOT IN (SELECT lead_id FROM {d}stg_leads)",
        "cross_company_signals_stay_apart": f"""SELECT 1 FROM identity_signals s JOIN (SELECT signal_type, signal_value FROM identity_signals WHERE signal_type IN ('PHONE', 'EMAIL') GROUP BY 1, 2 HAVING count(DISTINCT empresa_id) > 1) c USING (signal_type, signal_value)
            JOIN {d}lead_identity_map m USING (raw_row_id) GROUP BY signal_type, signal_value, m.customer_identity_id HAVING count(DISTINCT s.empresa_id) > 1""",
        "one_company_per_identity": f"SELECT 1 FROM {d}lead_identity_map GROUP BY customer_identity_id HAVING count(DISTINCT empresa_id) <> 1",
        "strong_signals_transitive": f"SELECT 1 FROM identity_signals s JOIN {d}lead_identity_map m USING (raw_row_id) WHERE s.empresa_id IS NOT NULL GROUP BY s.empresa_id, signal_type, signal_value HAVING count(DISTINCT m.customer_identity_id) > 1",
        "unique:sku,punto_venta_id": "SELECT 1 FROM catalog_availability GROUP BY sku, punto_venta_id HAVING count(*) > 1",
        "match_score_in_range": f"SELECT 1 FROM {match} WHERE match_score < 0 OR match_score > 1",
        "matched_iff_sku": f"SELECT 1 FROM {match} WHERE (match_status = 'MATCHED' AND sku IS NULL) OR (match_status IN ('AMBIGUOUS', 'UNMATCHED', 'MISSING') AND sku IS NOT NULL)",
        "duplicates_share_identity": f"SELECT 1 FROM {d}lead_identity_map m JOIN (SELECT raw_row_id, lead_id AS l, empresa_id AS e FROM {d}stg_leads) USING (raw_row_id) WHERE (l, e) IN (SELECT lead_id, min(empresa_id) FROM stg_leads WHERE lead_id IN ({known}) GROUP BY 1) GROUP BY m.customer_identity_id, e HAVING count(*) < 2 OR count(DISTINCT l) <> 1",
        "mart_catalog_lineage": f"SELECT 1 FROM {d}leads_enriched m JOIN {match} i USING (raw_row_id) WHERE {' OR '.join(f'm.{c} IS DISTINCT FROM i.{c}' for c in ('sku', 'modelo_canonico', 'precio_lista', 'match_method', 'match_score', 'match_status', 'is_available_at_store'))}",
        "one_company_per_mart_identity": f"SELECT 1 FROM {d}leads_enriched GROUP BY customer_identity_id HAVING count(DISTINCT empresa_id) <> 1",
        "mart_identity_lineage": f"SELECT 1 FROM {d}leads_enriched m JOIN {d}lead_identity_map i USING (raw_row_id) WHERE m.customer_identity_id IS DISTINCT FROM i.customer_identity_id OR m.empresa_id IS DISTINCT FROM i.empresa_id",
        "mart_duplicates": f"SELECT lead_id FROM {d}leads_enriched WHERE lead_id IN ({known}) GROUP BY 1 HAVING count(*) <> 2",
        "known_lead_present": f"SELECT 1 WHERE NOT EXISTS (SELECT 1 FROM {d}leads_enriched WHERE lead_id = {X.KNOWN_LEAD!r})",
        "conversation_count_positive": f"SELECT 1 FROM {d}lead_conversation_features WHERE conversation_count < 1",
        "ai_mart_keeps_grain": same(f"{d}leads_enriched", "leads_ai_enriched", equal),
        "mart_matches_staging": same(f"{d}stg_leads", f"{d}leads_enriched", once),
        "capacity_not_negative": f"SELECT 1 FROM {d}stg_asesores WHERE capacidad_diaria_leads < 0",
        "catalogue_values_positive": f"SELECT 1 FROM {d}stg_catalogo_motos WHERE precio_lista <= 0 OR unidades_disponibles < 0",
        "closed_follows_outcome": f"SELECT 1 FROM {d}stg_historico_cierres WHERE (desenlace_normalizado = 'cerrado' AND is_closed IS DISTINCT FROM true) OR (desenlace_normalizado = 'perdido' AND is_closed IS DISTINCT FROM false) OR (desenlace_normalizado = 'sin gestion' AND is_closed IS NOT NULL)",
        "store_format": f"SELECT 1 FROM {d}stg_leads WHERE NOT regexp_matches(punto_venta_id, '^PV-[0-9]{{3}}$')",
    })


STEPS: dict[str, str] = {n.lower(): X.duckdb(getattr(X, n)) for n in ("LEADS", "CATALOG", "ADVISORS", "HISTORY", "TURNS", "CONVERSATION_HEADS", "EXTRACTIONS", "REVIEWS", "SCORES", "EVENTS", "HELP")}
STEPS = {f"fx_{k}": v for k, v in STEPS.items()}
STEPS |= {
    "stg_leads": f"""SELECT raw_row_id, lead_id, empresa_id, punto_venta_id, nombre_cliente, {blank('canal')} AS canal_raw, {mapped(nt(blank('canal')), T.CHANNELS)} AS canal_normalizado,
        {blank('estado_gestion')} AS estado_gestion_raw, {mapped(nt(blank('estado_gestion')), T.STATES)} AS estado_gestion_normalizado, {blank('ciudad')} AS ciudad_raw, {mapped(nt(blank('ciudad')), T.CITIES)} AS ciudad_normalizada,
        {blank('telefono')} AS telefono_raw, {phone(blank('telefono'))} AS telefono_normalizado, {phone_status(blank('telefono'))} AS telefono_parse_status, {blank('email')} AS email_raw, {nt(blank('email'))} AS email_normalizado,
        {blank('modelo_interes_texto')} AS modelo_interes_raw, nullif({lex(blank('modelo_interes_texto'))}, '') AS modelo_interes_normalizado, {dated('fecha_registro')}, {dated('fecha_primer_contacto')}, {blank('campania')} AS campania_raw, {blank('campania')} AS campania_normalizada FROM fx_leads""",
    "stg_catalogo_motos": f"""SELECT sku, {blank('marca')} AS marca_raw, nullif({nt('marca')}, '') AS marca_normalizada, {blank('linea')} AS linea_raw, nullif({lex('linea')}, '') AS linea_normalizada,
        CASE WHEN {blank('marca')} IS NOT NULL AND {blank('linea')} IS NOT NULL THEN trim(marca) || ' ' || trim(linea) END AS modelo_canonico, nullif({lex("coalesce(marca, '') || ' ' || coalesce(linea, '')")}, '') AS modelo_normalizado,
        {blank('cilindraje')} AS cilindraje_raw, {integer('cilindraje')} AS cilindraje, {status('cilindraje')} AS cilindraje_parse_status, {blank('segmento')} AS segmento_raw, nullif({nt('segmento')}, '') AS segmento_normalizado,
        {blank('precio_lista')} AS precio_lista_raw, {decimal('precio_lista')} AS precio_lista, {status('precio_lista', DECIMAL)} AS precio_lista_parse_status, {blank('puntos_venta_disponibles')} AS puntos_venta_disponibles_raw,
        {blank('unidades_disponibles')} AS unidades_disponibles_raw, {integer('unidades_disponibles')} AS unidades_disponibles, {status('unidades_disponibles')} AS unidades_disponibles_parse_status FROM fx_catalog""",
    "stg_asesores": f"""SELECT asesor_id, nombre, punto_venta_id, empresa_id, {blank('capacidad_diaria_leads')} AS capacidad_diaria_leads_raw, {integer('capacidad_diaria_leads')} AS capacidad_diaria_leads, {status('capacidad_diaria_leads')} AS capacidad_diaria_leads_parse_status,
        {blank('activo')} AS activo_raw, {mapped(nt('activo'), YES)} AS activo, CASE WHEN activo IS NULL THEN 'MISSING' WHEN {nt('activo')} IN ('si', 'no') THEN 'VALID' ELSE 'INVALID' END AS activo_parse_status, {dated('fecha_ingreso')} FROM fx_advisors""",
    "stg_historico_cierres": f"""SELECT raw_row_id, lead_id, {dated('fecha_registro')}, {blank('canal')} AS canal_raw, {mapped(nt('canal'), T.CHANNELS)} AS canal_normalizado, empresa_id, punto_venta_id, {blank('modelo_cotizado')} AS modelo_cotizado_raw,
        nullif({lex('modelo_cotizado')}, '') AS modelo_cotizado_normalizado, {blank('precio_lista')} AS precio_lista_raw, {decimal('precio_lista')} AS precio_lista, {blank('horas_al_primer_contacto')} AS horas_al_primer_contacto_raw, {decimal('horas_al_primer_contacto')} AS horas_al_primer_contacto,
        {blank('numero_contactos')} AS numero_contactos_raw, {integer('numero_contactos')} AS numero_contactos, {blank('forma_pago_declarada')} AS forma_pago_declarada_raw, nullif({nt('forma_pago_declarada')}, '') AS forma_pago_declarada_normalizada,
        {blank('manifesto_cuota_inicial')} AS manifesto_cuota_inicial_raw, {mapped(nt('manifesto_cuota_inicial'), YES)} AS manifesto_cuota_inicial, {blank('pidio_cita')} AS pidio_cita_raw, {mapped(nt('pidio_cita'), YES)} AS pidio_cita,
        {blank('desenlace')} AS desenlace_raw, nullif({nt('desenlace')}, '') AS desenlace_normalizado, {mapped(nt('desenlace'), T.OUTCOMES)} AS is_closed FROM fx_history""",
    "stg_conversations": f"""SELECT h.conversacion_id, lead_id, {blank('canal')} AS canal_raw, {mapped(nt(blank('canal')), T.CHANNELS)} AS canal_normalizado, {dated('fecha_inicio')}, n_messages
        FROM fx_conversation_heads h JOIN (SELECT conversacion_id, count(*) AS n_messages FROM fx_turns GROUP BY 1) m ON m.conversacion_id = h.conversacion_id""",
    "invalid_leads": "SELECT * FROM stg_leads WHERE telefono_parse_status = 'INVALID' OR fecha_registro_parse_status = 'INVALID' OR fecha_primer_contacto_parse_status = 'INVALID' OR (canal_normalizado IS NULL AND canal_raw IS NOT NULL) OR (estado_gestion_normalizado IS NULL AND estado_gestion_raw IS NOT NULL)",
    "message_amounts": f"SELECT conversacion_id, turn, {amount('texto')} AS amount FROM fx_turns",
    "help_chunks": r"""SELECT stem || '-' || lpad(cast(row_number() OVER (PARTITION BY stem ORDER BY g) AS VARCHAR), 2, '0') AS slug, CASE WHEN g = 0 THEN upper(substr(stem, 1, 1)) || lower(substr(stem, 2)) ELSE head END AS title, stem AS section, content
        FROM (SELECT stem, g, max(h) AS head, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT is_head), ''), '^\s+|\s+$', '', 'g') AS content
          FROM (SELECT *, sum(cast(is_head AS INT)) OVER (PARTITION BY stem ORDER BY n) AS g, CASE WHEN is_head THEN regexp_extract(line, '^#{1,2}\s+(.+?)\s*$', 1) END AS h
            FROM (SELECT stem, n, line, regexp_matches(line, '^#{1,2}\s+(.+?)\s*$') AS is_head FROM (SELECT stem, unnest(regexp_split_to_array(text, '\r?\n')) AS line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) AS n FROM fx_help))) GROUP BY stem, g)
        WHERE content <> ''""",
    "search_terms": f"""SELECT slug, title, term, sum(w)::BIGINT AS w FROM (SELECT slug, title, 4 AS w, unnest(list_distinct(string_split({lex('title')}, ' '))) AS term FROM help_chunks
        UNION ALL SELECT slug, title, 2, unnest(list_distinct(string_split({lex('section')}, ' '))) FROM help_chunks UNION ALL SELECT slug, title, 1, unnest(list_distinct(string_split({lex('content')}, ' '))) FROM help_chunks) WHERE length(term) > 1 GROUP BY ALL""",
    "search_asked": f"""SELECT query_id, asked, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT slug AS query_id, unnest(list_distinct(list_slice(string_split({lex('content')}, ' '), 1, 3))) AS asked FROM help_chunks WHERE slug LIKE '%-02') WHERE length(asked) > 1""",
    "search_pairs": """SELECT asked, asked AS term, true AS whole FROM (SELECT DISTINCT asked FROM search_asked)
        UNION ALL SELECT asked, term, false FROM (SELECT DISTINCT asked FROM search_asked WHERE length(asked) >= 3) JOIN (SELECT DISTINCT term FROM search_terms) ON contains(term, asked) AND term <> asked""",
    "chunk_search": """SELECT query_id, slug, title, tier, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, title, slug) AS rank FROM
        (SELECT query_id, slug, title, CASE WHEN found = n THEN 1 WHEN found > 0 THEN 2 ELSE 3 END AS tier, CASE WHEN found > 0 THEN exact ELSE loose END AS score FROM
          (SELECT query_id, slug, title, count(*) FILTER (whole) AS found, any_value(n) AS n, coalesce(sum(w) FILTER (whole), 0)::BIGINT AS exact, sum(w)::BIGINT AS loose FROM search_asked JOIN search_pairs USING (asked) JOIN search_terms USING (term) GROUP BY 1, 2, 3))) WHERE rank <= 3""",
    "lead_models": f"SELECT DISTINCT {model('modelo_interes_raw')} AS model FROM stg_leads WHERE {model('modelo_interes_raw')} <> ''",
    "catalog_names": f"SELECT sku, {model('marca_raw')} AS brand, {model('linea_raw')} AS line, {model('''concat_ws(' ', marca_raw, linea_raw)''')} AS name FROM stg_catalogo_motos",
    "model_aliases": """SELECT alias_normalizado, sku FROM (SELECT m.model AS alias_normalizado, coalesce(e.sku, l.sku, s.sku) AS sku FROM lead_models m
        LEFT JOIN (SELECT name, max(sku) AS sku FROM catalog_names GROUP BY name) e ON e.name = regexp_replace(m.model, ' 2026$', '')
        LEFT JOIN (SELECT line, min(sku) AS sku FROM catalog_names GROUP BY line HAVING count(*) = 1) l ON l.line = m.model
        LEFT JOIN (SELECT m.model, min(c.sku) AS sku FROM lead_models m JOIN catalog_names c ON starts_with(c.name, m.model || ' ') GROUP BY m.model HAVING count(*) = 1) s ON s.model = m.model
        WHERE m.model NOT IN (SELECT name FROM catalog_names)) WHERE sku IS NOT NULL""",
    "model_fuzzy_matches": """WITH rest AS (SELECT model FROM lead_models WHERE model NOT IN (SELECT name FROM catalog_names WHERE name <> '') AND model NOT IN (SELECT alias_normalizado FROM model_aliases)),
        letters AS (SELECT model, c, sum(1::HUGEINT << (i - 1)::HUGEINT)::HUGEINT AS m FROM (SELECT model, unnest(string_split(model, '')) AS c, generate_subscripts(string_split(model, ''), 1) AS i FROM rest) GROUP BY 1, 2),
        masks AS (SELECT model, map(list(c ORDER BY c), list(m ORDER BY c)) AS masks, (1::HUGEINT << length(model)::HUGEINT) - 1 AS whole FROM letters GROUP BY model),
        pairs AS (SELECT model, sku, name, list_reduce(list_prepend(whole, list_transform(string_split(name, ''), lambda c: coalesce(masks[c], 0::HUGEINT))), lambda v, m: ((v + (v & m)) | (v - (v & m))) & whole) AS v FROM masks, catalog_names WHERE name <> ''),
        scored AS (SELECT model, sku, name, 2 * (length(model) - bit_count(v)) / (length(model) + length(name))::DOUBLE AS s FROM pairs),
        placed AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY s DESC, sku) AS r FROM scored QUALIFY r <= 2),
        two AS (SELECT model, max(name) FILTER (r = 1) AS top_1, max(s) FILTER (r = 1) AS s1, max(name) FILTER (r = 2) AS top_2, coalesce(max(s) FILTER (r = 2), 0) AS s2, max(sku) FILTER (r = 1) AS sku FROM placed GROUP BY model)
        SELECT model AS modelo_interes_normalizado, top_1, round(s1, 4) AS top_1_score, top_2, round(s2, 4) AS top_2_score, round(s1 - s2, 4) AS margin,
          CASE WHEN model IN (SELECT brand FROM catalog_names) OR (SELECT count(*) FROM catalog_names WHERE starts_with(name, model || ' ')) > 1 THEN 'AMBIGUOUS' WHEN s1 >= 0.9 AND s1 - s2 >= 0.1 THEN 'MATCHED' ELSE 'REVIEW' END AS decision, sku FROM two""",
    "catalog_availability": "SELECT DISTINCT sku, trim(p) AS punto_venta_id FROM (SELECT sku, unnest(string_split(puntos_venta_disponibles_raw, '|')) AS p FROM stg_catalogo_motos) WHERE trim(p) <> ''",
    "lead_model_match_exact": """SELECT l.raw_row_id, l.lead_id, l.empresa_id, l.punto_venta_id, l.modelo_interes_normalizado, coalesce(e.sku, a.sku) AS sku, c.modelo_canonico, c.marca_normalizada, c.linea_normalizada, c.precio_lista,
        CASE WHEN e.sku IS NOT NULL THEN 'normalized_exact' WHEN a.sku IS NOT NULL THEN 'alias' ELSE 'none' END AS match_method, CASE WHEN coalesce(e.sku, a.sku) IS NOT NULL THEN 1.0::DOUBLE END AS match_score,
        CASE WHEN l.modelo_interes_normalizado IS NULL THEN 'MISSING' WHEN coalesce(e.sku, a.sku) IS NOT NULL THEN 'MATCHED' ELSE 'UNMATCHED' END AS match_status,
        CASE WHEN coalesce(e.sku, a.sku) IS NOT NULL AND l.punto_venta_id IS NOT NULL THEN v.sku IS NOT NULL END AS is_available_at_store
        FROM stg_leads l LEFT JOIN (SELECT modelo_normalizado, min(sku) AS sku FROM stg_catalogo_motos WHERE modelo_normalizado IS NOT NULL GROUP BY 1) e ON e.modelo_normalizado = l.modelo_interes_normalizado
        LEFT JOIN model_aliases a ON a.alias_normalizado = l.modelo_interes_normalizado LEFT JOIN stg_catalogo_motos c ON c.sku = coalesce(e.sku, a.sku)
        LEFT JOIN catalog_availability v ON v.sku = coalesce(e.sku, a.sku) AND v.punto_venta_id = l.punto_venta_id""",
    "lead_model_match": """SELECT l.raw_row_id, l.lead_id, l.empresa_id, l.punto_venta_id, l.modelo_interes_normalizado, l.sku, c.modelo_canonico, c.marca_normalizada, c.linea_normalizada, c.precio_lista,
        CASE WHEN l.sku_exact IS NOT NULL THEN 'normalized_exact' WHEN l.sku_alias IS NOT NULL THEN 'alias' WHEN l.decision IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS match_method,
        CASE WHEN coalesce(l.sku_exact, l.sku_alias) IS NOT NULL THEN 1.0::DOUBLE ELSE l.top_1_score END AS match_score,
        CASE WHEN l.modelo_interes_normalizado IS NULL THEN 'MISSING' WHEN l.sku IS NOT NULL THEN 'MATCHED' ELSE coalesce(l.decision, 'UNMATCHED') END AS match_status,
        CASE WHEN l.sku IS NOT NULL AND l.punto_venta_id IS NOT NULL THEN v.sku IS NOT NULL END AS is_available_at_store
        FROM (SELECT s.*, e.sku AS sku_exact, a.sku AS sku_alias, f.decision, f.top_1_score, coalesce(e.sku, a.sku, CASE WHEN f.decision = 'MATCHED' THEN f.sku END) AS sku FROM stg_leads s
            LEFT JOIN (SELECT modelo_normalizado, min(sku) AS sku FROM stg_catalogo_motos WHERE modelo_normalizado IS NOT NULL GROUP BY 1) e ON e.modelo_normalizado = s.modelo_interes_normalizado
            LEFT JOIN model_aliases a ON a.alias_normalizado = s.modelo_interes_normalizado LEFT JOIN model_fuzzy_matches f ON f.modelo_interes_normalizado = s.modelo_interes_normalizado) l
        LEFT JOIN stg_catalogo_motos c ON c.sku = l.sku LEFT JOIN catalog_availability v ON v.sku = l.sku AND v.punto_venta_id = l.punto_venta_id""",
    "identity_signals": f"""SELECT DISTINCT * FROM (SELECT raw_row_id, lead_id, empresa_id, 'SOURCE_LEAD_ID' AS signal_type, trim(lead_id) AS signal_value FROM stg_leads WHERE empresa_id IS NOT NULL AND trim(lead_id) <> ''
        UNION ALL SELECT raw_row_id, lead_id, empresa_id, 'PHONE', telefono_normalizado FROM stg_leads WHERE empresa_id IS NOT NULL AND telefono_parse_status = 'VALID'
        UNION ALL SELECT raw_row_id, lead_id, empresa_id, 'EMAIL', email_normalizado FROM stg_leads WHERE regexp_matches(email_normalizado, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AND email_normalizado NOT IN ({', '.join(repr(e) for e in DUMMY_EMAILS)})
          AND email_normalizado NOT LIKE 'test@%' AND email_normalizado NOT LIKE 'prueba@%' AND email_normalizado NOT LIKE 'noemail@%')""",
    "identity_components": """WITH RECURSIVE hub AS (SELECT empresa_id, signal_type, signal_value, min(raw_row_id) AS u FROM identity_signals WHERE empresa_id IS NOT NULL GROUP BY 1, 2, 3),
        half AS (SELECT DISTINCT h.u, s.raw_row_id AS v FROM hub h JOIN identity_signals s USING (empresa_id, signal_type, signal_value)), edge AS (SELECT u, v FROM half UNION SELECT v, u FROM half),
        walk(a, b) AS (SELECT DISTINCT u, u FROM edge UNION SELECT w.a, e.v FROM walk w JOIN edge e ON e.u = w.b) SELECT a AS raw_row_id, min(b) AS component_key FROM walk GROUP BY a""",
    "lead_identity_map": """SELECT l.raw_row_id, l.lead_id, l.empresa_id, n.customer_identity_id, s.members AS identity_member_count, s.members > 1 AS is_duplicate_identity, s.members > s.ids AS is_source_duplicate, s.channels > 1 AS has_multiple_channels,
          n.signal_types, n.signals FROM identity_components c JOIN stg_leads l USING (raw_row_id)
        JOIN (SELECT component_key, empresa_id, 'CID_' || md5(empresa_id || '|' || coalesce(min(signal_value) FILTER (signal_type = 'PHONE'), min(signal_value) FILTER (signal_type = 'EMAIL'), min(signal_value) FILTER (signal_type = 'SOURCE_LEAD_ID'))) AS customer_identity_id,
            array_to_string(list_sort(list(DISTINCT signal_type)), ',') AS signal_types, array_to_string(list_sort(list(DISTINCT md5(signal_value) || ':' || signal_type)), ',') AS signals
          FROM identity_signals JOIN identity_components USING (raw_row_id) WHERE empresa_id IS NOT NULL GROUP BY 1, 2) n ON n.component_key = c.component_key AND n.empresa_id = l.empresa_id
        JOIN (SELECT component_key, count(*) AS members, count(DISTINCT lead_id) AS ids, count(DISTINCT canal_normalizado) AS channels FROM identity_components JOIN stg_leads USING (raw_row_id) GROUP BY 1) s ON s.component_key = c.component_key""",
    "grown_identity_map": "SELECT * FROM lead_identity_map",
    "customer_identity": """SELECT m.customer_identity_id, m.empresa_id, count(*) AS member_count, count(DISTINCT l.lead_id) AS lead_id_count, count(DISTINCT telefono_normalizado) AS phone_count, count(DISTINCT email_normalizado) AS email_count,
        count(DISTINCT canal_normalizado) AS channel_count, bool_or(is_source_duplicate) AS has_source_duplicate, array_to_string(list_sort(list(DISTINCT l.lead_id)), ',') AS lead_ids, coalesce(array_to_string(list_sort(list(DISTINCT canal_normalizado)), ','), '') AS channels
        FROM lead_identity_map m JOIN stg_leads l USING (raw_row_id) GROUP BY 1, 2""",
    "cross_company_signals": "SELECT signal_type, md5(signal_value) AS signal_value_hash, count(DISTINCT empresa_id) AS company_count, count(DISTINCT raw_row_id) AS lead_count FROM identity_signals WHERE signal_type IN ('PHONE', 'EMAIL') AND empresa_id IS NOT NULL GROUP BY signal_type, signal_value HAVING count(DISTINCT empresa_id) > 1",
    "conversation_messages": """SELECT conversacion_id AS conversation_id, lead_id, fecha_inicio AS conversation_started_at, canal_normalizado AS conversation_channel, cast(row_number() OVER (PARTITION BY conversacion_id ORDER BY turn) AS INT) AS message_index,
        hora AS message_time, emisor AS speaker, texto AS message_text FROM stg_conversations JOIN fx_turns USING (conversacion_id)""",
    "rendered_conversations": "SELECT conversacion_id AS conversation_id, string_agg(upper(emisor) || ': ' || texto, chr(10) ORDER BY turn) AS conversation_text, sha256(string_agg(upper(emisor) || ': ' || texto, chr(10) ORDER BY turn)) AS conversation_hash FROM fx_turns GROUP BY 1",
    "planned_cases": """SELECT c.conversation_id, c.conversation_hash, CASE k.s WHEN 'SUCCESS' THEN 'cached' WHEN 'ERROR' THEN 'skipped_error' ELSE 'pending' END AS plan_status FROM (SELECT DISTINCT conversation_id, conversation_hash FROM fx_extractions) c
        LEFT JOIN (SELECT conversation_id, conversation_hash, max(status) AS s FROM fx_extractions WHERE semantic_prompt_hash = 'p1' AND batch_contract_version = 'v1' AND model_requested = 'm1' GROUP BY 1, 2) k USING (conversation_id, conversation_hash)""",
    "case_batches": "SELECT conversation_id, cast(floor((row_number() OVER (ORDER BY conversation_id) - 1) / 7) AS BIGINT) AS batch_no FROM (SELECT DISTINCT conversation_id FROM fx_extractions)",
    "reconciled_responses": """SELECT c.conversation_id, CASE WHEN n IS NULL THEN 'missing_response_id' WHEN n > 1 THEN 'duplicate_response_id' WHEN NOT valid THEN 'structured_output_invalid' END AS error_type,
        CASE WHEN n = 1 AND valid THEN 'SUCCESS' ELSE 'ERROR' END AS status FROM (SELECT DISTINCT conversacion_id AS conversation_id FROM fx_conversation_heads) c
        LEFT JOIN (SELECT conversation_id, count(*) AS n, bool_and(status = 'SUCCESS') AS valid FROM fx_extractions WHERE semantic_prompt_hash = 'p1' GROUP BY 1) r USING (conversation_id)""",
    "current_extractions": """SELECT e.conversation_id, c.lead_id, c.fecha_inicio AS conversation_started_at, e.extraction_id, modelo_interes, presupuesto, cuota_inicial, forma_pago, intencion, objecion_principal, pidio_cita, pidio_cotizacion, evidence_grounded, processed_at
        FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY processed_at DESC NULLS LAST, updated_at DESC NULLS LAST, extraction_id) AS n FROM fx_extractions WHERE status = 'SUCCESS') e JOIN stg_conversations c ON c.conversacion_id = e.conversation_id WHERE n = 1""",
    "orphan_conversations": "SELECT conversation_id, lead_id, conversation_started_at FROM current_extractions WHERE lead_id IS NULL OR lead_id NOT IN (SELECT lead_id FROM stg_leads)",
    "lead_conversation_features": """SELECT lead_id, count(*) AS conversation_count, string_agg(conversation_id, ',' ORDER BY conversation_started_at NULLS LAST, conversation_id) AS conversation_ids, min(conversation_started_at) AS first_conversation_at, max(conversation_started_at) AS latest_conversation_at,
        first(conversation_id ORDER BY conversation_started_at DESC NULLS LAST, conversation_id DESC) AS latest_conversation_id,
        first(modelo_interes ORDER BY conversation_started_at DESC NULLS LAST, conversation_id DESC) FILTER (modelo_interes IS NOT NULL) AS modelo_interes, first(presupuesto ORDER BY conversation_started_at DESC NULLS LAST, conversation_id DESC) FILTER (presupuesto IS NOT NULL) AS presupuesto,
        first(cuota_inicial ORDER BY conversation_started_at DESC NULLS LAST, conversation_id DESC) FILTER (cuota_inicial IS NOT NULL) AS cuota_inicial,
        coalesce(first(forma_pago ORDER BY conversation_started_at DESC NULLS LAST, conversation_id DESC) FILTER (forma_pago IN ('credito', 'contado')), 'no_informa') AS forma_pago,
        coalesce(first(intencion ORDER BY conversation_started_at DESC NULLS LAST, conversation_id DESC) FILTER (intencion <> 'indeterminada'), 'indeterminada') AS intencion,
        first(objecion_principal ORDER BY conversation_started_at DESC NULLS LAST, conversation_id DESC) FILTER (objecion_principal IS NOT NULL) AS objecion_principal, bool_or(coalesce(pidio_cita, false)) AS pidio_cita, bool_or(coalesce(pidio_cotizacion, false)) AS pidio_cotizacion,
        bool_and(coalesce(evidence_grounded, false)) AS conversation_evidence_grounded_all, count(*) FILTER (evidence_grounded) AS conversation_evidence_grounded_count, count(*) FILTER (NOT evidence_grounded) AS conversation_evidence_not_grounded_count
        FROM current_extractions WHERE lead_id IN (SELECT lead_id FROM stg_leads) GROUP BY lead_id""",
    "leads_enriched": """SELECT l.raw_row_id, l.lead_id, l.empresa_id, l.punto_venta_id, l.nombre_cliente, l.canal_normalizado, l.telefono_raw, l.email_raw, l.fecha_registro, l.modelo_interes_normalizado, i.customer_identity_id, i.identity_member_count, i.is_duplicate_identity, i.has_multiple_channels,
        m.sku, m.modelo_canonico, m.precio_lista, m.match_method, m.match_score, m.match_status, m.is_available_at_store, l.telefono_parse_status = 'VALID' AS has_valid_phone, m.match_status = 'MATCHED' AS has_resolved_model, l.fecha_registro_parse_status = 'AMBIGUOUS' AS has_ambiguous_registration_date
        FROM stg_leads l LEFT JOIN lead_identity_map i USING (raw_row_id) LEFT JOIN lead_model_match_exact m USING (raw_row_id)""",
    "leads_ai_enriched": """SELECT l.*, c.lead_id IS NOT NULL AS has_conversation, coalesce(c.conversation_count, 0) AS conversation_count, c.latest_conversation_id, c.intencion AS conversation_intencion, c.forma_pago AS conversation_forma_pago, c.cuota_inicial AS conversation_cuota_inicial,
        c.pidio_cita AS conversation_pidio_cita, c.pidio_cotizacion AS conversation_pidio_cotizacion FROM leads_enriched l LEFT JOIN lead_conversation_features c USING (lead_id)""",
    "scored_leads": f"""SELECT *, round(conversation_component + sla_component + availability_component + propensity_component, 2) AS priority_score FROM (SELECT raw_row_id, lead_id, empresa_id, punto_venta_id, fecha_registro, propensity_score, propensity_percentile, age AS lead_age_hours,
          CASE WHEN has_conversation THEN least(45.0, CASE conversation_intencion WHEN 'alta' THEN 15.0 WHEN 'media' THEN 8.0 WHEN 'baja' THEN 2.0 ELSE 0.0 END + CASE WHEN conversation_pidio_cita THEN 10.0 ELSE 0.0 END + CASE WHEN conversation_pidio_cotizacion THEN 8.0 ELSE 0.0 END
            + CASE WHEN conversation_cuota_inicial > 0 AND conversation_forma_pago = 'credito' THEN 7.0 ELSE 0.0 END + CASE WHEN conversation_forma_pago IN ('credito', 'contado') THEN 5.0 ELSE 0.0 END) ELSE 0.0 END::DOUBLE AS conversation_component,
          CASE WHEN age >= 48 THEN 30.0 WHEN age >= 24 THEN 20.0 WHEN age >= 12 THEN 10.0 WHEN age >= 4 THEN 5.0 ELSE 0.0 END::DOUBLE AS sla_component, CASE WHEN is_available_at_store THEN 20.0 WHEN is_available_at_store IS NULL THEN 8.0 ELSE 0.0 END::DOUBLE AS availability_component,
          CASE WHEN propensity_percentile >= 0.8 THEN 5.0 WHEN propensity_percentile >= 0.5 THEN 3.0 WHEN propensity_percentile >= 0.2 THEN 1.0 ELSE 0.0 END::DOUBLE AS propensity_component
        FROM (SELECT m.*, s.propensity_score, CASE WHEN s.propensity_score IS NOT NULL THEN (row_number() OVER (PARTITION BY s.propensity_score IS NULL ORDER BY s.propensity_score, m.raw_row_id) - 1) / greatest(count(s.propensity_score) OVER () - 1, 1)::DOUBLE END AS propensity_percentile,
          coalesce(greatest(epoch(TIMESTAMP {X.DAY} - fecha_registro::TIMESTAMP) / 3600.0, 0.0), 0.0)::DOUBLE AS age FROM leads_ai_enriched m LEFT JOIN fx_scores s USING (raw_row_id)))""",
    "assignments": f"""SELECT DATE {X.DAY} AS assignment_date, l.* EXCLUDE (slot_no), CASE WHEN priority_score >= 60 THEN 'HOT' WHEN priority_score >= 35 THEN 'WARM' ELSE 'COLD' END AS temperature, row_number() OVER (ORDER BY priority_score DESC, fecha_registro NULLS LAST, raw_row_id) AS global_priority_rank, l.slot_no AS store_priority_rank, p.asesor_id AS advisor_id,
        CASE WHEN p.asesor_id IS NOT NULL THEN 'ASSIGNED' WHEN EXISTS (SELECT 1 FROM stg_asesores a WHERE a.activo AND a.empresa_id IS NOT DISTINCT FROM l.empresa_id AND a.punto_venta_id IS NOT DISTINCT FROM l.punto_venta_id) THEN 'UNASSIGNED_CAPACITY' ELSE 'NO_ELIGIBLE_ADVISOR' END AS assignment_status
        FROM (SELECT *, row_number() OVER (PARTITION BY empresa_id, punto_venta_id ORDER BY priority_score DESC, fecha_registro NULLS LAST, raw_row_id) AS slot_no FROM scored_leads) l
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY empresa_id, punto_venta_id ORDER BY k / cap::DOUBLE, k, asesor_id) AS slot_no FROM (SELECT empresa_id, punto_venta_id, asesor_id, capacidad_diaria_leads AS cap, unnest(range(capacidad_diaria_leads)) AS k FROM stg_asesores WHERE activo AND capacidad_diaria_leads > 0)) p
          ON p.empresa_id IS NOT DISTINCT FROM l.empresa_id AND p.punto_venta_id IS NOT DISTINCT FROM l.punto_venta_id AND p.slot_no = l.slot_no""",
    "responded_events": f"""SELECT e.event_id, DATE {X.DAY} AS assignment_date, e.raw_row_id, a.empresa_id, CASE WHEN e.event_id % 10 = 0 THEN 'nobody' ELSE a.advisor_id END AS advisor_id, e.responded, e."at", cast(e.user_id AS VARCHAR) AS "by" FROM fx_events e JOIN assignments a USING (raw_row_id) WHERE event_type = 'click'""",
    "responded_assignments": """SELECT a.*, CASE WHEN e.responded THEN e."at" END AS responded_at, CASE WHEN e.responded THEN e."by" END AS responded_by FROM assignments a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY raw_row_id ORDER BY "at" DESC, event_id DESC) AS n FROM
        (SELECT v.* FROM responded_events v JOIN assignments a ON a.raw_row_id = v.raw_row_id AND a.empresa_id = v.empresa_id AND a.advisor_id = v.advisor_id AND a.assignment_status = 'ASSIGNED')) e ON e.raw_row_id = a.raw_row_id AND e.n = 1""",
    "assignment_summary": """SELECT count(*) AS leads, count(*) FILTER (assignment_status = 'ASSIGNED') AS assigned, count(*) FILTER (assignment_status = 'UNASSIGNED_CAPACITY') AS unassigned_capacity, count(*) FILTER (assignment_status = 'NO_ELIGIBLE_ADVISOR') AS no_eligible_advisor,
        count(*) FILTER (temperature = 'HOT') AS hot, count(*) FILTER (temperature = 'WARM') AS warm, count(*) FILTER (temperature = 'COLD') AS cold, (SELECT coalesce(sum(capacidad_diaria_leads), 0)::BIGINT FROM stg_asesores WHERE activo) AS active_capacity, count(*) FILTER (assignment_status = 'ASSIGNED') AS capacity_used FROM assignments""",
    "daily_leads": """SELECT raw_row_id, lead_id, empresa_id, priority_score, company_priority_rank, temperature, advisor_id, assignment_status, modelo, canal FROM (SELECT a.*, coalesce(m.modelo_canonico, m.modelo_interes_normalizado) AS modelo, m.canal_normalizado AS canal, m.nombre_cliente, m.telefono_raw,
        row_number() OVER (PARTITION BY a.empresa_id ORDER BY a.priority_score DESC, a.fecha_registro NULLS LAST, a.raw_row_id) AS company_priority_rank FROM responded_assignments a JOIN leads_ai_enriched m USING (raw_row_id) WHERE a.empresa_id = 'E1')
        WHERE temperature = 'WARM' AND responded_at IS NULL AND (nombre_cliente ILIKE '%7%' OR lead_id ILIKE '%7%' OR telefono_raw ILIKE '%7%' OR modelo ILIKE '%7%')""",
    "manager_summary": """SELECT a.empresa_id, count(*) AS total_leads, count(*) FILTER (assignment_status = 'ASSIGNED') AS assigned, count(*) FILTER (assignment_status = 'UNASSIGNED_CAPACITY') AS backlog, count(*) FILTER (assignment_status = 'NO_ELIGIBLE_ADVISOR') AS no_eligible,
        count(*) FILTER (temperature = 'HOT') AS hot, count(*) FILTER (temperature = 'WARM') AS warm, count(*) FILTER (temperature = 'COLD') AS cold, count(*) FILTER (temperature = 'HOT' AND assignment_status = 'UNASSIGNED_CAPACITY') AS hot_backlog,
        count(*) FILTER (assignment_status = 'ASSIGNED' AND responded_at IS NOT NULL) AS responded, count(*) FILTER (assignment_status = 'ASSIGNED' AND responded_at IS NULL) AS pending_response, coalesce(max(c.cap), 0)::BIGINT AS capacity_total, count(*) FILTER (assignment_status = 'ASSIGNED') AS capacity_used,
        coalesce(round(100.0 * count(*) FILTER (assignment_status = 'ASSIGNED' AND responded_at IS NOT NULL) / nullif(count(*) FILTER (assignment_status = 'ASSIGNED'), 0), 2), 0)::DOUBLE AS managed_pct
        FROM responded_assignments a LEFT JOIN (SELECT empresa_id, sum(capacidad_diaria_leads) AS cap FROM stg_asesores WHERE activo GROUP BY 1) c ON c.empresa_id = a.empresa_id GROUP BY a.empresa_id""",
    "advisor_capacity": """SELECT s.empresa_id, s.asesor_id, s.nombre, s.punto_venta_id, s.capacidad_diaria_leads::BIGINT AS capacidad, count(a.raw_row_id) AS asignados, count(a.responded_at) AS responded, count(a.raw_row_id) - count(a.responded_at) AS pending_response,
        count(a.raw_row_id) / nullif(s.capacidad_diaria_leads, 0)::DOUBLE AS load_ratio FROM stg_asesores s LEFT JOIN responded_assignments a ON a.advisor_id = s.asesor_id AND a.assignment_status = 'ASSIGNED' WHERE s.activo GROUP BY 1, 2, 3, 4, s.capacidad_diaria_leads""",
    "store_summary": """SELECT a.empresa_id, a.punto_venta_id, count(*) AS leads, count(*) FILTER (assignment_status = 'ASSIGNED') AS assigned, count(*) FILTER (assignment_status = 'UNASSIGNED_CAPACITY') AS backlog, count(*) FILTER (temperature = 'HOT') AS hot, coalesce(max(c.cap), 0)::BIGINT AS capacity
        FROM responded_assignments a LEFT JOIN (SELECT empresa_id, punto_venta_id, sum(capacidad_diaria_leads) AS cap FROM stg_asesores WHERE activo GROUP BY 1, 2) c ON c.empresa_id = a.empresa_id AND c.punto_venta_id = a.punto_venta_id GROUP BY 1, 2""",
    "filter_options": "SELECT DISTINCT a.punto_venta_id, a.advisor_id, s.nombre AS advisor_name, m.canal_normalizado AS canal FROM responded_assignments a JOIN leads_ai_enriched m USING (raw_row_id) LEFT JOIN stg_asesores s ON s.asesor_id = a.advisor_id WHERE a.empresa_id = 'E2'",
    "lead_detail": "SELECT a.*, m.* EXCLUDE (raw_row_id, lead_id, empresa_id, punto_venta_id, fecha_registro) FROM responded_assignments a JOIN leads_ai_enriched m USING (raw_row_id) WHERE raw_row_id = '0000000007'",
    "lead_history": "SELECT * FROM conversation_messages WHERE lead_id IN (SELECT lead_id FROM responded_assignments WHERE empresa_id = 'E1')",
    "upserted_scores": """SELECT coalesce(o.raw_row_id, n.raw_row_id) AS raw_row_id, CASE WHEN n.raw_row_id IS NOT NULL THEN n.propensity_score ELSE o.propensity_score END AS propensity_score, CASE WHEN n.raw_row_id IS NOT NULL THEN 'new' ELSE 'old' END AS model_version
        FROM (SELECT * FROM fx_scores WHERE cast(raw_row_id AS BIGINT) % 3 <> 0) o FULL JOIN (SELECT raw_row_id, 1 - propensity_score AS propensity_score FROM fx_scores WHERE cast(raw_row_id AS BIGINT) % 2 = 0) n ON n.raw_row_id = o.raw_row_id""",
    "operational_validation": validation_sql("") + "\nUNION ALL " + day_sql(""),
    "operational_validation_damaged": validation_sql("damaged_"),
    "data_checks": checks_sql(""),
    "data_checks_damaged": checks_sql("damaged_"),
    **{f"damaged_{t}": f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in columns.items())}) FROM {DAMAGED_FROM.get(t, t)}" for t, columns in X.DAMAGE.items()},
    "extraction_metrics": """SELECT count(*) AS cases, avg((a.status = 'SUCCESS')::INT) AS success_rate, count(*) FILTER (a.error_type = 'structured_output_invalid') AS structured_failures, bool_and(coalesce(a.evidence_grounded, false)) FILTER (a.status = 'SUCCESS') AS grounded_all,
        count(*) FILTER (NOT a.evidence_grounded) AS grounding_failures, avg(a.latency_seconds) FILTER (a.status = 'SUCCESS') AS mean_latency_seconds, (SELECT avg(accuracy) FROM field_quality) AS macro_accuracy, (SELECT avg(accuracy_end_to_end) FROM field_quality) AS macro_accuracy_end_to_end,
        (SELECT '{' || string_agg('"' || error_type || '":' || n, ',' ORDER BY error_type) || '}' FROM (SELECT error_type, count(*) AS n FROM fx_extractions JOIN (SELECT conversation_id FROM current_extractions) USING (conversation_id) WHERE error_type <> '' GROUP BY 1)) AS errors_by_type FROM fx_extractions a JOIN current_extractions b USING (conversation_id)""",
    "csv_round_trip": f"SELECT {', '.join(CONTRACTS['leads'])} FROM fx_leads",
    "conversation_round_trip": "SELECT h.conversacion_id, lead_id, canal, fecha_inicio, row_number() OVER (PARTITION BY h.conversacion_id ORDER BY turn) AS n, emisor, texto, hora FROM fx_conversation_heads h JOIN fx_turns t ON t.conversacion_id = h.conversacion_id",
    "ingestion_log": """SELECT 1 AS run, 'LOADED' AS status, 5::BIGINT AS files, (SELECT count(*) FROM fx_leads) + (SELECT count(*) FROM fx_catalog) + (SELECT count(*) FROM fx_advisors) + (SELECT count(*) FROM fx_history) + (SELECT count(*) FROM fx_conversation_heads) AS rows
        UNION ALL SELECT 2, 'SKIPPED', 5, 0""",
    "nul_free_messages": "SELECT conversacion_id, turn, emisor, texto FROM fx_turns",
    "leakage_report": """SELECT feature, classification, used, n AS rows_present FROM (VALUES {audit}) AS a(feature, classification, used) JOIN (SELECT unnest(['canal_normalizado', 'empresa_id', 'punto_venta_id', 'modelo_feature', 'precio_lista', 'manifesto_cuota_inicial', 'pidio_cita', 'horas_al_primer_contacto', 'numero_contactos', 'forma_pago_declarada', 'desenlace']) AS feature,
        unnest([count(canal_normalizado), count(empresa_id), count(punto_venta_id), count(modelo_cotizado_normalizado), count(precio_lista), count(manifesto_cuota_inicial), count(pidio_cita), count(horas_al_primer_contacto), count(numero_contactos), count(forma_pago_declarada_normalizada), count(desenlace_normalizado)]) AS n FROM stg_historico_cierres) USING (feature)""".replace("{audit}", ", ".join(f"('{f}', '{c}', {u})" for f, c, u, _ in LEAKAGE_AUDIT)),
    "golden_set": """SELECT conversation_id, conversation_text, nullif(trim(modelo_interes), '') AS modelo_interes, try_cast(trim(presupuesto) AS DOUBLE) AS presupuesto, try_cast(trim(cuota_inicial) AS DOUBLE) AS cuota_inicial, trim(forma_pago) AS forma_pago, trim(intencion) AS intencion, nullif(trim(objecion_principal), '') AS objecion_principal,
        CASE lower(trim(pidio_cita)) WHEN 'true' THEN true WHEN 'false' THEN false END AS pidio_cita, CASE lower(trim(pidio_cotizacion)) WHEN 'true' THEN true WHEN 'false' THEN false END AS pidio_cotizacion FROM fx_reviews WHERE lower(trim(reviewed)) = 'true'""",
    "training_split": """SELECT part, count(*) AS rows, sum(label)::DOUBLE AS positives, min(fecha_registro) AS first_day, max(fecha_registro) AS last_day FROM (SELECT *, CASE WHEN fecha_registro <= (SELECT min(d) FROM (SELECT fecha_registro AS d, sum(count(*)) OVER (ORDER BY fecha_registro) AS upto FROM training GROUP BY 1)
        WHERE upto >= greatest(1, floor((SELECT count(*) FROM training) * 0.8))) THEN 'train' ELSE 'test' END AS part FROM training) GROUP BY part""",
    "training": "SELECT *, CASE desenlace_normalizado WHEN 'cerrado' THEN 1.0 ELSE 0.0 END AS label FROM stg_historico_cierres WHERE desenlace_normalizado IN ('cerrado', 'perdido')",
    "ranked_history": "SELECT raw_row_id, fecha_registro, label, (hash_key % 1000)::DOUBLE / 1000 AS score FROM (SELECT *, cast(substr(raw_row_id, 1, 10) AS BIGINT) * 31 + cast(substr(raw_row_id, 12) AS BIGINT) * 7 AS hash_key FROM (SELECT raw_row_id, min(fecha_registro) AS fecha_registro, max(label) AS label FROM training GROUP BY 1))",
    "prediction_quality": """SELECT count(*) AS rows, round(avg(label), 9)::DOUBLE AS positive_rate, round((SELECT sum((n - p) * (tp - p / 2.0)) / (sum(p) * (sum(n) - sum(p))) FROM steps)::DOUBLE, 9) AS roc_auc, round((SELECT sum(p * tp / seen) / sum(p) FROM steps)::DOUBLE, 9) AS average_precision, round(avg((score - label) ** 2)::DOUBLE, 9) AS brier FROM ranked_history""",
    "steps": "SELECT p, n, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM (SELECT score, sum(label) AS p, count(*) AS n FROM ranked_history GROUP BY 1) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)",
    "ranking_quality": """SELECT ranking, k, hits / k AS precision, hits / pos AS recall, hits / k / (pos / n) AS lift FROM (SELECT ranking, k, sum(label)::DOUBLE AS hits, max(pos)::DOUBLE AS pos, max(n)::DOUBLE AS n FROM (SELECT *, count(*) OVER (PARTITION BY ranking) AS n, sum(label) OVER (PARTITION BY ranking) AS pos, greatest(1, ceil(count(*) OVER (PARTITION BY ranking) * 0.1))::BIGINT AS k FROM
        (SELECT 'model' AS ranking, label, row_number() OVER (ORDER BY score DESC, raw_row_id) AS r FROM ranked_history UNION ALL SELECT 'fifo', label, row_number() OVER (ORDER BY fecha_registro NULLS LAST, raw_row_id) FROM ranked_history)) WHERE r <= k GROUP BY ranking, k)""",
    "capacity_share": "SELECT (SELECT coalesce(sum(capacidad_diaria_leads), 0)::BIGINT FROM stg_asesores WHERE activo) AS active_capacity, count(*) AS rows, (SELECT coalesce(sum(capacidad_diaria_leads), 0) FROM stg_asesores WHERE activo)::DOUBLE / nullif(count(*), 0) AS capacity_share FROM stg_leads",
    "error_classes": "SELECT cls AS error_class, count(*) AS n FROM (SELECT CASE event_id % 7 WHEN 0 THEN 'output_length_limit' WHEN 1 THEN 'rate_limit' WHEN 2 THEN 'request_timeout' WHEN 3 THEN 'model_unavailable' WHEN 4 THEN 'request_error' WHEN 5 THEN 'model_unavailable' ELSE 'structured_output_invalid' END AS cls FROM fx_events) GROUP BY 1",
    "field_quality": """SELECT field, count(*) FILTER (c AND ok) AS correct, count(*) FILTER (ok) AS labeled, count(*) FILTER (c AND ok) / count(*) FILTER (ok)::DOUBLE AS accuracy, count(*) FILTER (c AND ok) / count(*)::DOUBLE AS accuracy_end_to_end FROM (SELECT a.status = 'SUCCESS' AS ok, unnest(['modelo_interes', 'presupuesto', 'cuota_inicial', 'forma_pago', 'intencion', 'objecion_principal', 'pidio_cita', 'pidio_cotizacion']) AS field,
        unnest([lower(b.modelo_interes) IS NOT DISTINCT FROM lower(a.modelo_interes), CASE WHEN a.presupuesto IS NULL OR b.presupuesto IS NULL THEN a.presupuesto IS NULL AND b.presupuesto IS NULL ELSE abs(a.presupuesto - b.presupuesto) <= greatest(0.01, 0.01 * abs(b.presupuesto)) END,
          CASE WHEN a.cuota_inicial IS NULL OR b.cuota_inicial IS NULL THEN a.cuota_inicial IS NULL AND b.cuota_inicial IS NULL ELSE abs(a.cuota_inicial - b.cuota_inicial) <= greatest(0.01, 0.01 * abs(b.cuota_inicial)) END, a.forma_pago = b.forma_pago, a.intencion = b.intencion,
          a.objecion_principal IS NOT DISTINCT FROM b.objecion_principal, a.pidio_cita IS NOT DISTINCT FROM b.pidio_cita, a.pidio_cotizacion IS NOT DISTINCT FROM b.pidio_cotizacion]) AS c FROM fx_extractions a JOIN current_extractions b USING (conversation_id)) GROUP BY field""",
    "profile_leads": f"""SELECT lead_id, empresa_id, {profile_city('ciudad')} AS city, {profile_phone('telefono')} AS phone, {profile_model('modelo_interes_texto')} AS model, coalesce({mapped(nt('canal'), T.CHANNELS)}, '') AS channel, coalesce({mapped(nt('estado_gestion'), T.STATES)}, '') AS state,
        CASE WHEN regexp_matches(trim(fecha_registro), '^\\d{{4}}-\\d{{2}}-\\d{{2}}([ T].*)?$') THEN 'ISO' WHEN regexp_matches(trim(fecha_registro), '^\\d{{2}}-\\d{{2}}-\\d{{4}}$') THEN 'DD-MM-YYYY' WHEN regexp_matches(trim(fecha_registro), '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}([ T].*)?$') THEN 'SLASH' ELSE 'OTHER' END AS date_format,
        {date_status('fecha_registro')} AS date_status FROM fx_leads""",
    "profile": f"""WITH measured AS (
        SELECT 'leads' AS section, unnest(['rows', 'distinct_ids', 'invalid_phones', 'cities', 'duplicate_ids', 'exact_catalog_hits']) AS metric, '' AS key, unnest([count(*), count(DISTINCT lead_id), count(*) FILTER (NOT starts_with(phone, '+57')), count(DISTINCT city),
            (SELECT count(*) FROM (SELECT 1 FROM profile_leads GROUP BY lead_id HAVING count(*) > 1)), count(*) FILTER (model IN (SELECT {profile_model("concat_ws(' ', marca, linea)")} FROM fx_catalog))]::DOUBLE[]) AS value FROM profile_leads
        UNION ALL SELECT 'phones', unnest(['duplicate_groups_global', 'duplicate_groups_cross_company', 'duplicate_groups_within_company']), '', unnest([count(*) FILTER (n > 1), count(*) FILTER (companies > 1), sum(inside)]::DOUBLE[])
          FROM (SELECT phone, sum(n) AS n, count(empresa_id) AS companies, count(*) FILTER (n > 1) AS inside FROM (SELECT phone, empresa_id, count(*) AS n FROM profile_leads WHERE phone IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
        UNION ALL SELECT 'leads', 'nulls', k, v FROM (UNPIVOT (SELECT {', '.join(f"count(*) FILTER (coalesce(trim({c}), '') = '')::DOUBLE AS {c}" for c in ['raw_row_id', *CONTRACTS['leads']])} FROM fx_leads) ON COLUMNS(*) INTO NAME k VALUE v)
        UNION ALL SELECT 'leads', 'channel', channel, count(*)::DOUBLE FROM profile_leads GROUP BY channel UNION ALL SELECT 'leads', 'state', state, count(*)::DOUBLE FROM profile_leads GROUP BY state
        UNION ALL SELECT 'leads', 'date_format', date_format, count(*)::DOUBLE FROM profile_leads GROUP BY date_format UNION ALL SELECT 'leads', 'date_status', date_status, count(*)::DOUBLE FROM profile_leads GROUP BY date_status
        UNION ALL SELECT 'conversations', unnest(['rows', 'average_messages', 'orphans', 'leads_with_several']), '', unnest([(SELECT count(*) FROM fx_conversation_heads), (SELECT round(count(*) / (SELECT count(*) FROM fx_conversation_heads)::DOUBLE, 4) FROM fx_turns),
          (SELECT count(*) FROM fx_conversation_heads WHERE lead_id IS NULL OR lead_id NOT IN (SELECT lead_id FROM fx_leads)), (SELECT count(*) FROM (SELECT 1 FROM fx_conversation_heads WHERE lead_id IS NOT NULL GROUP BY lead_id HAVING count(*) > 1))]::DOUBLE[])
        UNION ALL SELECT 'catalog', unnest(['rows', 'brands']), '', unnest([count(*), count(DISTINCT marca)]::DOUBLE[]) FROM fx_catalog
        UNION ALL SELECT 'advisors', unnest(['active', 'inactive', 'active_capacity']), '', unnest([count(*) FILTER (activo), count(*) FILTER (NOT activo), coalesce(sum(capacidad_diaria_leads) FILTER (activo), 0)]::DOUBLE[]) FROM stg_asesores
        UNION ALL SELECT 'history', unnest(['rows', 'close_rate', 'close_rate_managed']), '', unnest([count(*), round(count(*) FILTER (o = 'cerrado') / count(*)::DOUBLE, 6), round(count(*) FILTER (o = 'cerrado') / (count(*) FILTER (o IN ('cerrado', 'perdido')))::DOUBLE, 6)]::DOUBLE[]) FROM (SELECT {nt('desenlace')} AS o FROM fx_history)
        UNION ALL SELECT 'history', 'outcome', coalesce({nt('desenlace')}, ''), count(*)::DOUBLE FROM fx_history GROUP BY ALL)
        SELECT * FROM measured""",
    "phone_profile": f"""SELECT count(*) FILTER (n > 1) AS duplicate_groups_global, count(*) FILTER (companies > 1) AS duplicate_groups_cross_company FROM (SELECT phone, count(*) AS n, count(DISTINCT empresa_id) AS companies FROM
        (SELECT empresa_id, CASE WHEN starts_with({digits('telefono')}, '0057') AND length({digits('telefono')}) = 14 THEN substr({digits('telefono')}, 5) WHEN starts_with({digits('telefono')}, '57') AND length({digits('telefono')}) = 12 THEN substr({digits('telefono')}, 3) ELSE {digits('telefono')} END AS phone FROM fx_leads WHERE telefono IS NOT NULL) GROUP BY 1)""",
}
STEPS["ranking_quality_20"] = STEPS["ranking_quality"].replace("* 0.1)", "* 0.2::DOUBLE)")
STEPS["ranking_quality_capacity"] = STEPS["ranking_quality"].replace("* 0.1)", "* (SELECT capacity_share FROM capacity_share))").replace("hits / k ", "hits / least(k, n) ")
STEPS["historical_rows"] = """SELECT raw_row_id, sha256({fields}) AS h FROM (SELECT raw_row_id, lead_id, fecha_registro, empresa_id, punto_venta_id, canal_normalizado, modelo_cotizado_normalizado AS modelo_feature,
    precio_lista::DOUBLE AS precio_lista, manifesto_cuota_inicial, pidio_cita, desenlace_normalizado FROM training)""".replace("{fields}", " || ".join(
    f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in "canal_normalizado desenlace_normalizado empresa_id fecha_registro lead_id manifesto_cuota_inicial modelo_feature pidio_cita precio_lista punto_venta_id raw_row_id".split()))
STEPS["dataset_hash"] = """WITH RECURSIVE nodes(level, i, h, n) AS (SELECT 0, row_number() OVER (ORDER BY raw_row_id, h) - 1, h, count(*) OVER () FROM historical_rows
    UNION ALL SELECT level + 1, i // 1024, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1023) // 1024 FROM nodes WHERE n > 1 GROUP BY level, i // 1024)
    SELECT (SELECT count(*) FROM historical_rows) AS rows, h AS dataset_hash FROM nodes WHERE n = 1"""


def query(name: str, final: str | None = None) -> str:
    """WITH all steps that `name` rests on, in order, and a SELECT of it."""
    order: list[str] = []

    def visit(step: str) -> None:
        for other in STEPS:
            if other != step and other not in order and re.search(rf"\b{other}\b", STEPS[step]):
                visit(other)
        if step not in order:
            order.append(step)

    visit(name)
    steps = ",\n".join(f"{s} AS MATERIALIZED (\n{STEPS[s]}\n)" for s in order)
    return f"WITH {steps}\n{final or f'SELECT * FROM {name}'}"
