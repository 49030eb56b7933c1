"""Facts that a client states, against what an extraction claims. Row-local: messages and evidence stay arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadflow.functions.text import parse_amount
from leadflow.operators.conversations import MOST_CHARACTERS, MOST_FRAGMENTS

# The phrases that the contract knows (a few stems end in a word boundary and so match whole words only).
AMOUNT = r"(\$?\s*\d+(?:[.,]\d+)*\s*(?:millones?|mil|palos?|mm?)?)"
INITIAL = rf"(?iu){AMOUNT}\s*(?:de|para(?:\s+la)?)?\s*(?:cuota\s+)?(?:inicial|entrada)\b"
CASH = r"(?iu)\bcontado\b"
CREDIT = r"(?iu)\b(?:a\s+cr[eé]dito|financiad[ao]|financiar(?:la|lo)?)\b"
LOW_INTENT = r"(?iu)\b(?:era\s+por\s+curiosidad|solo\s+estaba\s+mirando|solo\s+estaba\s+averiguando\s+por\s+curiosidad)\b"
STRONG_INTENT = r"(?iu)\b(?:voy\b|ya\s+voy|quiero\s+comprar|sep[aá]rem|agend|puedo\s+pasar)\b"
QUOTE_REQUEST = r"(?iu)\b(?:cotiz|cu[aá]nto\s+me\s+queda|en\s+cu[aá]nto\s+queda|simul|valor|cuotas?)\b"
QUOTE_ACCEPTED = r"(?iu)\b(?:m[aá]ndela|env[ií]emela|s[ií],?\s+env[ií]e)"
QUOTE_OFFER = r"(?iu)\b(?:cotiz|simul)\w*"
APPOINTMENT = r"(?iu)\b(?:voy\s+(?:esta|hoy|ma[ñn]ana)|ya\s+voy\s+en\s+camino|visito|puedo\s+pasar|agend)"


def _by(message: Column, speaker: str) -> Column:
    return F.lower(F.coalesce(message["emisor"], F.lit(""))) == speaker


def _fragments(field: str) -> Column:
    """Texts of the client's evidence for a field."""
    own = F.filter("evidencia", lambda e: (e["campo"] == field) & _by(e, "cliente") & e["fragmento"].isNotNull())
    return F.transform(own, lambda e: e["fragmento"])


def enforce_customer_signal_evidence(df: DataFrame) -> DataFrame:
    """Clear what only an advisor said: model and amounts without a client's fragment become null, a payment
    form becomes no_informa, requests become false. A value with fragments takes the money that the first of
    them names, the model too, which a later validation then rejects (kept as the contract has it)."""
    new = {}
    for field in ("modelo_interes", "presupuesto", "cuota_inicial"):
        kind = df.schema[field].dataType
        said = _fragments(field)
        amount = parse_amount(F.try_element_at(said, F.lit(1)))
        new[field] = F.when(F.col(field).isNotNull() & (F.size(said) > 0), F.coalesce(amount.cast(kind), F.col(field)))
    paid = F.col("forma_pago")
    new["forma_pago"] = F.when(paid.isin("credito", "contado") & (F.size(_fragments("forma_pago")) == 0), F.lit("no_informa")).otherwise(paid)
    for field in ("pidio_cita", "pidio_cotizacion"):
        new[field] = F.when(F.col(field) & (F.size(_fragments(field)) == 0), F.lit(False)).otherwise(F.col(field))
    return df.withColumns(new)


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def reconcile_explicit_facts(df: DataFrame) -> DataFrame:
    """Set what a client states outright in `mensajes`: payment form, initial amount, budget, low intent,
    a quote asked for or accepted after an offer, an appointment; each with its message as evidence
    (no repeats, five at most). Rows without a client's message stay as they are."""
    at = F.transform("mensajes", lambda m, i: F.struct(i.alias("i"), m["emisor"].alias("emisor"), m["texto"].alias("t")))
    df = df.withColumn("_said", F.filter(at, lambda m: _by(m, "cliente") & (F.length(F.trim(F.coalesce(m["t"], F.lit("")))) > 0)))
    offers = F.filter(at, lambda m: _by(m, "asesor") & F.coalesce(m["t"], F.lit("")).rlike(QUOTE_OFFER))
    df = df.withColumn("_offer", F.array_min(F.transform(offers, lambda m: m["i"])))

    def facts(m: Column) -> Column:
        t = m["t"]
        question = t.contains("?")
        cash, credit = t.rlike(CASH), t.rlike(CREDIT)
        initial = t.rlike(INITIAL)
        return F.struct(
            t.alias("t"),
            F.when(cash & ~(question & credit), "contado").when(credit & ~(question & cash), "credito").alias("paid"),
            F.when(initial, parse_amount(F.regexp_extract(t, INITIAL, 1))).alias("initial"),
            F.when(~initial, parse_amount(t)).alias("budget"),
            t.rlike(LOW_INTENT).alias("low"),
            t.rlike(STRONG_INTENT).alias("strong"),
            (t.rlike(QUOTE_REQUEST) | (t.rlike(QUOTE_ACCEPTED) & F.coalesce(F.col("_offer") < m["i"], F.lit(False)))).alias("quote"),
            t.rlike(APPOINTMENT).alias("visit"),
        )

    # one message at a time has one row, so the facts of a message are computed once
    df = df.withColumn("_f", F.transform("_said", facts))
    with_value = lambda field: F.filter("_f", lambda f: f[field].isNotNull())
    true = lambda field: F.filter("_f", lambda f: f[field])
    df = df.withColumns({
        "_paid": _last(with_value("paid")), "_initial": _last(with_value("initial")), "_budget": _last(with_value("budget")),
        "_low": F.when(F.size(true("strong")) == 0, _last(true("low"))), "_quote": _last(true("quote")), "_visit": F.try_element_at(true("visit"), F.lit(1)),
    })
    cash = F.col("_initial").isNull() & (F.col("_paid.paid") == "contado")
    steps = [
        ("forma_pago", F.col("_paid")), ("cuota_inicial", F.col("_initial")), ("presupuesto", F.when(cash, F.col("_budget"))),
        ("intencion", F.col("_low")), ("pidio_cotizacion", F.col("_quote")), ("pidio_cita", F.col("_visit")),
    ]
    evidence = F.col("evidencia")
    df = df.withColumn("_ev", F.array_compact(F.array(*[F.when(x.isNotNull(), F.struct(F.lit(n).alias("campo"), F.substring(x["t"], 1, MOST_CHARACTERS).alias("fragmento"), F.lit("cliente").alias("emisor"))) for n, x in steps])))
    add = lambda have, e: F.when((F.size(have) < MOST_FRAGMENTS) & ~F.array_contains(have, e), F.concat(have, F.array(e))).otherwise(have)
    return df.withColumns({
        "forma_pago": F.coalesce("_paid.paid", "forma_pago"),
        "cuota_inicial": F.when(F.col("_initial").isNotNull(), F.col("_initial.initial")).when(cash, F.lit(None)).otherwise(F.col("cuota_inicial")),
        "presupuesto": F.when(cash & F.col("_budget").isNotNull(), F.col("_budget.budget")).otherwise(F.col("presupuesto")),
        "intencion": F.when(F.col("_low").isNotNull(), "baja").otherwise(F.col("intencion")),
        "pidio_cotizacion": F.when(F.col("_quote").isNotNull(), True).otherwise(F.col("pidio_cotizacion")),
        "pidio_cita": F.when(F.col("_visit").isNotNull(), True).otherwise(F.col("pidio_cita")),
        "evidencia": F.aggregate("_ev", evidence, add),
    }).drop("_said", "_offer", "_f", "_paid", "_initial", "_budget", "_low", "_quote", "_visit", "_ev")
