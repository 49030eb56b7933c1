"""Evaluation: extraction quality against reviewed labels, and ranking quality of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.functions.text import normalize_model
from leadflow.operators.conversations import INTENTS, OBJECTIONS, PAYMENTS
from leadflow.operators.ranking import global_rank
from leadflow.plans.session import materialise

TEXT_FIELDS = ("forma_pago", "intencion", "objecion_principal")
NUMBER_FIELDS = ("presupuesto", "cuota_inicial")
FLAG_FIELDS = ("pidio_cita", "pidio_cotizacion")
FIELDS = ("modelo_interes", *NUMBER_FIELDS, *TEXT_FIELDS, *FLAG_FIELDS)


def numbers_agree(expected: Column, actual: Column) -> Column:
    """Equal within 0.01 or one per cent of the expected; null equals null alone."""
    close = F.abs(expected - actual) <= F.greatest(F.lit(0.01), 0.01 * F.abs(expected))
    return F.when(expected.isNull() | actual.isNull(), expected.isNull() & actual.isNull()).otherwise(close)


def _compared(results: DataFrame) -> DataFrame:
    """One row per case and field: {ok (the case succeeded), field, correct}."""
    blank = lambda c: F.nullif(normalize_model(c), F.lit(""))
    df = results.withColumns({"_em": blank("expected.modelo_interes"), "_am": blank("actual.modelo_interes")})
    tests = {"modelo_interes": F.col("_em").eqNullSafe(F.col("_am"))}
    tests |= {f: numbers_agree(F.col(f"expected.{f}"), F.col(f"actual.{f}")) for f in NUMBER_FIELDS}
    tests |= {f: F.col(f"expected.{f}").eqNullSafe(F.col(f"actual.{f}")) for f in (*TEXT_FIELDS, *FLAG_FIELDS)}
    ok = F.col("status") == "ok"
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), t.alias("correct")) for f, t in tests.items()]))
    return df.select(ok.alias("ok"), F.col("actual").isNotNull().alias("told"), each.alias("x")).select("ok", "x.field", (F.col("x.correct") & F.col("told")).alias("correct"))


def field_metrics(results: DataFrame) -> DataFrame:
    """By field: correct and labelled among successes, and accuracy there and over all cases (a case without an answer is wrong)."""
    n_ok, right = F.count_if("ok"), F.count_if(F.col("correct") & F.col("ok"))
    return _compared(results).groupBy("field").agg(right.alias("correct"), n_ok.alias("labeled"), (right / F.when(n_ok > 0, n_ok)).alias("accuracy"), (F.count_if("correct") / F.count("*")).alias("accuracy_end_to_end"))


def extraction_metrics(results: DataFrame) -> DataFrame:
    """One row: cases, success rate, mean field accuracy on successes and end to end, grounding, latency, and errors by type.

    Latency and grounded_all are of successes, and null without one; a failed grounding counts wherever it is recorded as
    failed (null is none); errors_by_type has the recorded types only."""
    macro = field_metrics(results).agg(F.avg("accuracy").alias("macro_accuracy"), F.avg("accuracy_end_to_end").alias("macro_accuracy_end_to_end"))
    ok = F.col("status") == "ok"
    kinds = results.where("error_type != ''").groupBy(F.col("error_type").alias("k")).agg(F.count("*").alias("n"))  # a row a type
    errors = kinds.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("errors_by_type"))
    whole = results.agg(
        F.count("*").alias("cases"), F.avg(ok.cast("double")).alias("success_rate"), F.count_if(F.coalesce(F.col("error_type") == "structured_output_invalid", F.lit(False))).alias("structured_failures"),
        F.bool_and(F.when(ok, F.coalesce("evidence_grounded", F.lit(False)))).alias("grounded_all"),
        F.count_if(F.col("evidence_grounded") == F.lit(False)).alias("grounding_failures"), F.avg(F.when(ok, F.col("latency_seconds"))).alias("mean_latency_seconds"),
    )
    return whole.join(F.broadcast(macro)).join(F.broadcast(errors))


def golden_set(review: DataFrame) -> DataFrame:
    """Reviewed labels only: blanks become null, flags and amounts are parsed, and an unknown value is an error."""
    b = lambda c: F.nullif(F.trim(c), F.lit(""))
    flag = lambda c: F.when(F.lower(b(c)) == "true", True).when(F.lower(b(c)) == "false", False)

    def enum(name: str, allowed: tuple, nullable: bool = False) -> Column:
        known = F.coalesce(b(name).isin(*allowed), F.lit(nullable))
        return F.when(known, b(name)).otherwise(F.raise_error(F.concat(F.lit(f"{name}: "), F.coalesce(name, F.lit("missing"))))).alias(name)

    return review.where(flag("reviewed")).select(
        "conversation_id", "conversation_text", b("modelo_interes").alias("modelo_interes"), *[b(c).try_cast("double").alias(c) for c in NUMBER_FIELDS],
        enum("forma_pago", PAYMENTS), enum("intencion", INTENTS), enum("objecion_principal", OBJECTIONS, True), *[flag(c).alias(c) for c in FLAG_FIELDS],
    )


def evaluate_predictions(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row: rows, positive rate, ROC-AUC, average precision and Brier score. Ties count half for the AUC and as
    one step for the precision. Rows are first reduced to distinct scores; those are ordered by range."""
    each = df.groupBy(F.col(score).alias("s")).agg(F.sum(label).alias("p"), F.count("*").alias("n"))
    parts = materialise(each.repartitionByRange(32, F.col("s").desc()).withColumn("_part", F.spark_partition_id()), "score-ranges")
    sums = parts.groupBy("_part").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    ahead = sums.select("_part", F.coalesce(F.sum("_p").over(earlier), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"))
    w = W.partitionBy("_part").orderBy(F.col("s").desc()).rowsBetween(W.unboundedPreceding, 0)
    run = parts.join(F.broadcast(ahead), "_part").select("p", "n", (F.col("_p0") + F.sum("p").over(w)).alias("tp"), (F.col("_n0") + F.sum("n").over(w)).alias("seen"))
    total = df.agg(F.count("*").alias("rows"), F.sum(label).alias("pos"), F.avg(F.pow(F.col(score) - F.col(label), 2)).alias("brier"))
    got = run.agg(
        F.sum(F.col("p") * F.col("tp") / F.col("seen")).alias("ap"),
        F.sum((F.col("n") - F.col("p")) * (F.col("tp") - F.col("p") / 2.0)).alias("area"),
    )
    pos, neg = F.col("pos"), F.col("rows") - F.col("pos")
    return total.join(F.broadcast(got)).select("rows", (pos / F.col("rows")).alias("positive_rate"), (F.col("area") / F.when((pos > 0) & (neg > 0), pos * neg)).alias("roc_auc"), (F.col("ap") / F.when(pos > 0, pos)).alias("average_precision"), "brier")


def ranking_metrics(df: DataFrame, fraction: float, label: str = "label", score: str = "score", fifo: str = "fecha_registro", key: str = "raw_row_id") -> DataFrame:
    """Two rows (model, fifo): precision, recall and lift among the first k = max(1, ceil(rows * fraction))."""
    n = df.agg(F.count("*").alias("rows"), F.sum(label).alias("pos")).withColumn("k", F.greatest(F.lit(1), F.ceil(F.col("rows") * F.lit(fraction))).cast("long"))
    out = None
    for name, order in (("model", [F.col(score).desc(), F.col(key).asc()]), ("fifo", [F.col(fifo).asc_nulls_last(), F.col(key).asc()])):
        slim = df.select(key, score if name == "model" else fifo, label)
        ranked = global_rank(slim, [], order, "_rank").join(F.broadcast(n))
        part = ranked.where("_rank <= k").agg(F.max("k").alias("k"), F.sum(label).alias("hits"), F.max("rows").alias("rows"), F.max("pos").alias("pos"))
        precision = F.col("hits") / F.least("k", "rows")  # k may be more than there are
        part = part.select(F.lit(name).alias("ranking"), "k", precision.alias("precision"), F.when(F.col("pos") > 0, F.col("hits") / F.col("pos")).otherwise(0.0).alias("recall"), (precision / F.when(F.col("pos") > 0, F.col("pos") / F.col("rows"))).alias("lift"))
        out = part if out is None else out.unionByName(part)
    return out
