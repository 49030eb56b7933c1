"""Propensity to close: temporal split, feature pipeline, logistic regression and scores."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadflow.operators.ranking import exact_percentile, group_rank
from leadflow.plans.session import materialise

CATEGORIES = ("empresa_id", "punto_venta_id", "canal_normalizado", "modelo_feature")
FLAGS = ("manifesto_cuota_inicial", "pidio_cita")
PRICE = "precio_lista"
MISSING = "__missing__"
# What may be a feature, and what is known only after the outcome.
LEAKAGE_AUDIT = (
    ("canal_normalizado", "PRE_OUTCOME", True, "known at registration"),
    ("empresa_id", "PRE_OUTCOME", True, "known at registration"),
    ("punto_venta_id", "PRE_OUTCOME", True, "known at registration"),
    ("modelo_feature", "PRE_OUTCOME", True, "stated by the customer"),
    ("precio_lista", "PRE_OUTCOME", True, "catalogue price"),
    ("manifesto_cuota_inicial", "PRE_OUTCOME", True, "stated by the customer"),
    ("pidio_cita", "PRE_OUTCOME", True, "stated by the customer"),
    ("horas_al_primer_contacto", "POST_REGISTRATION", False, "depends on how the lead was managed"),
    ("numero_contactos", "POST_REGISTRATION", False, "grows until the outcome"),
    ("forma_pago_declarada", "POST_REGISTRATION", False, "recorded with the outcome"),
    ("desenlace", "TARGET", False, "is the outcome"),
)


def leakage_audit(spark) -> DataFrame:
    return spark.createDataFrame(LEAKAGE_AUDIT, "feature string, classification string, used boolean, reason string")


def check_contract(columns) -> None:
    """Refuse features that the audit doesn't allow, and frames that lack one."""
    used = {f for f, _, ok, _ in LEAKAGE_AUDIT if ok}
    if missing := used - set(columns):
        raise ValueError(f"missing features: {sorted(missing)}")


def training_set(history: DataFrame) -> DataFrame:
    """History with an outcome, from stg_historico_cierres."""
    return history.where("desenlace_normalizado in ('cerrado', 'perdido')").select(
        "raw_row_id", "lead_id", "fecha_registro", "empresa_id", "punto_venta_id", "canal_normalizado", F.col("modelo_cotizado_normalizado").alias("modelo_feature"),
        F.col("precio_lista").cast("double").alias("precio_lista"), "manifesto_cuota_inicial", "pidio_cita", "desenlace_normalizado",
    )


def serving_set(mart: DataFrame) -> DataFrame:
    """The lead mart as features. What a customer declared later is not known here: manifesto_cuota_inicial is null."""
    return mart.select(
        "raw_row_id", "lead_id", "fecha_registro", "empresa_id", "punto_venta_id", "canal_normalizado", F.coalesce("modelo_canonico", "modelo_interes_normalizado").alias("modelo_feature"),
        F.col("precio_lista").cast("double").alias("precio_lista"), F.lit(None).cast("boolean").alias("manifesto_cuota_inicial"), F.col("conversation_pidio_cita").alias("pidio_cita"),
    )


def target_from_outcome(df: DataFrame) -> DataFrame:
    """df with label 1.0 for cerrado and 0.0 for perdido; any other outcome fails the job."""
    o = F.col("desenlace_normalizado")
    bad = F.raise_error(F.concat(F.lit("unexpected outcome: "), F.coalesce(o, F.lit("null"))))
    return df.withColumn("label", F.when(o == "cerrado", 1.0).when(o == "perdido", 0.0).otherwise(bad.cast("double")))


def temporal_cutoff(df: DataFrame, share: float = 0.8) -> DataFrame:
    """One row {cutoff}: the date of row max(1, int(share * n)) in date order. Works on counts per date."""
    days = df.where("fecha_registro is not null").groupBy("fecha_registro").agg(F.count("*").alias("n"))
    run = days.withColumn("upto", F.sum("n").over(W.orderBy("fecha_registro")))  # one row a date
    total = days.agg(F.greatest(F.lit(1), F.floor(F.sum("n") * F.lit(share))).alias("want"))
    return run.join(F.broadcast(total)).where("upto >= want").agg(F.min("fecha_registro").alias("cutoff"))


def temporal_split(df: DataFrame, share: float = 0.8) -> tuple[DataFrame, DataFrame, object]:
    """(train up to the cutoff date, test after it, cutoff); a missing date or an empty test set is an error."""
    if df.where("fecha_registro is null").limit(1).count():
        raise ValueError("a training row has no date")
    cutoff = temporal_cutoff(df, share).first()["cutoff"]
    train, test = df.where(F.col("fecha_registro") <= F.lit(cutoff)), df.where(F.col("fecha_registro") > F.lit(cutoff))
    if cutoff is None or not test.limit(1).count():
        raise ValueError("no row after the cutoff")
    return train, test, cutoff


def _prepared(df: DataFrame, price: float, modes: dict[str, bool]) -> DataFrame:
    flags = {f: F.coalesce(F.col(f), F.lit(modes[f])).cast("double") for f in FLAGS}
    return df.withColumns({PRICE: F.coalesce(PRICE, F.lit(price)), **{c: F.coalesce(c, F.lit(MISSING)) for c in CATEGORIES}, **flags})


class PropensityModel:
    """Imputation values of the training set and the fitted pipeline."""

    def __init__(self, pipeline: PipelineModel, price: float, modes: dict[str, bool], levels: list[str]):
        self.pipeline, self.price, self.modes, self.levels = pipeline, price, modes, levels

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(_prepared(df, self.price, self.modes)).withColumn("propensity_score", vector_to_array("probability")[1])


def build_features() -> Pipeline:
    """One-hot categories (every level; unknown ones are zeros), standardised price and flags."""
    stages = [StringIndexer(inputCols=list(CATEGORIES), outputCols=[f"{c}_ix" for c in CATEGORIES], handleInvalid="keep", stringOrderType="alphabetAsc")]
    stages.append(OneHotEncoder(inputCols=[f"{c}_ix" for c in CATEGORIES], outputCols=[f"{c}_hot" for c in CATEGORIES], dropLast=True, handleInvalid="error"))
    stages.append(VectorAssembler(inputCols=[PRICE], outputCol="_price"))
    stages.append(StandardScaler(inputCol="_price", outputCol="_scaled", withMean=True, withStd=True))
    stages.append(VectorAssembler(inputCols=["_scaled", *[f"{c}_hot" for c in CATEGORIES], *FLAGS], outputCol="features"))
    return Pipeline(stages=stages)


def build_regression(n_train: int) -> LogisticRegression:
    """An L2 logistic regression whose strength equals a cost of 1 over n rows; _weight says how many rows a row stands for."""
    return LogisticRegression(regParam=1.0 / n_train, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8, weightCol="_weight")


def fit_propensity(train: DataFrame) -> PropensityModel:
    """Fit on rows with label. Price takes the median, flags the most frequent value (false in a tie).

    The regression goes over the rows hundreds of times: rows that are equal in label and features are one row for it, with
    their number as weight, which leaves its sums as they are. Levels, means and deviations come from all rows."""
    check_contract(train.columns)
    row = train.agg(F.count("*").alias("n"), *[F.avg(F.col(f).cast("double")).alias(f) for f in FLAGS]).first()
    price, modes = float(exact_percentile(train, PRICE, 0.5) or 0.0), {f: (row[f] or 0.0) > 0.5 for f in FLAGS}
    ready = _prepared(train, price, modes).select("label", PRICE, *CATEGORIES, *FLAGS)
    features = build_features().fit(ready)
    weighed = materialise(ready.groupBy(*ready.columns).agg(F.count(F.lit(1)).cast("double").alias("_weight")), "training-weights")
    regression = build_regression(row["n"]).fit(features.transform(weighed).select("label", "features", "_weight"))
    levels = [PRICE, *[f"{c}={v}" for c, vs in zip(CATEGORIES, features.stages[0].labelsArray) for v in vs], *FLAGS]
    return PropensityModel(PipelineModel([*features.stages, regression]), price, modes, levels)


def score_serving(model: PropensityModel, serving: DataFrame, model_version: str, training_hash: str, scored_at: str) -> DataFrame:
    """Scores of the serving rows; nothing is fitted."""
    if not model_version or not training_hash:
        raise ValueError("scores need a model version and the hash of its training data")
    out = model.transform(serving)
    return out.select("raw_row_id", "lead_id", "propensity_score", F.lit(model_version).alias("model_version"), F.lit(training_hash).alias("training_data_hash"), F.lit(scored_at).cast("timestamp").alias("scored_at"))


def coefficient_report(spark, model: PropensityModel) -> DataFrame:
    """{feature, coefficient, abs_coefficient, direction}, the strongest first; zero counts as positive."""
    values = model.pipeline.stages[-1].coefficients.toArray().tolist()
    rows = [(n, float(v), abs(float(v)), "positive" if v >= 0 else "negative") for n, v in zip(model.levels, values)]
    return spark.createDataFrame(rows, "feature string, coefficient double, abs_coefficient double, direction string").orderBy(F.col("abs_coefficient").desc(), "feature")


FINGERPRINT_RUN = 1024


def dataset_hash(df: DataFrame, key: str = "raw_row_id") -> DataFrame:
    """One row {rows, dataset_hash}: a fingerprint of the rows in the order of `key`.

    A row is hashed as `bytes:value` of each column (`-` for a null) in the order of their names; runs of FINGERPRINT_RUN rows are
    hashed together, then runs of those, until one hash is left. Rows that share a key follow their hashes, so the
    order in which they are read does not count; rows that change places by key do. No rows: the hash of nothing.
    """
    value = lambda c: F.col(f"`{c}`").cast("string")
    text = F.concat(*[F.coalesce(F.concat(F.octet_length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in sorted(df.columns)])
    nodes = group_rank(df.select(F.col(f"`{key}`").alias("k"), F.sha2(text.cast("binary"), 256).alias("h")), [], [F.col("k"), F.col("h")], "i")
    nodes = nodes.select((F.col("i") - 1).alias("i"), "h")
    rows = left = nodes.count()
    while left > 1:
        run = F.array_sort(F.collect_list(F.struct("i", "h")))  # FINGERPRINT_RUN rows
        nodes = materialise(nodes.groupBy(F.floor(F.col("i") / FINGERPRINT_RUN).alias("j")).agg(run.alias("r")).select(F.col("j").alias("i"), F.sha2(F.array_join(F.transform("r", lambda x: x["h"]), "").cast("binary"), 256).alias("h")), "fingerprint")
        left = -(-left // FINGERPRINT_RUN)
    return nodes.agg(F.lit(rows).cast("long").alias("rows"), F.coalesce(F.max("h"), F.sha2(F.lit("").cast("binary"), 256)).alias("dataset_hash"))


def capacity_share(advisors: DataFrame, mart: DataFrame) -> DataFrame:
    room = advisors.agg(F.coalesce(F.sum(F.when(F.col("activo"), F.col("capacidad_diaria_leads"))), F.lit(0)).alias("active_capacity"))
    rows = mart.agg(F.count("*").alias("rows"))
    return room.join(F.broadcast(rows)).withColumn("capacity_share", F.col("active_capacity") / F.when(F.col("rows") > 0, F.col("rows")))
