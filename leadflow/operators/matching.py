"""Catalogue matching: aliases, fuzzy candidates, and the model of each lead."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadflow.functions.text import normalize_model
from leadflow.operators.similarity import nearest
from leadflow.plans.session import materialise

SCORE, MARGIN = 0.90, 0.10


def lead_models(leads: DataFrame) -> DataFrame:
    """Distinct normalised models that leads name: {model}."""
    return leads.select(normalize_model("modelo_interes_raw").alias("model")).where("model != ''").distinct()


def catalog_names(catalog: DataFrame) -> DataFrame:
    """{sku, brand, line, name, position}: normalised names in catalogue order (by sku)."""
    named = catalog.select("sku", normalize_model("marca_raw").alias("brand"), normalize_model("linea_raw").alias("line"), normalize_model(F.concat_ws(" ", "marca_raw", "linea_raw")).alias("name"))
    return named.where("name != ''")


def beginnings(names: DataFrame) -> DataFrame:
    """{sku, start}: the proper whole-word beginnings of names, so that looking for one is an equality join."""
    words = names.select("sku", F.split("name", " ").alias("w")).where(F.size("w") > 1)
    return words.select("sku", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.array_join(F.slice("w", F.lit(1), k), " "))).alias("start"))


def build_aliases(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """models {model}, catalogue -> {alias_normalizado, sku} of names that are not catalogue names themselves.

    In order: the catalogue's name without a trailing ` 2026` (of rows that share it the last in catalogue order); a line that exactly one sku has; a name of
    which the model is a whole-word beginning, if exactly one catalogue row has it.
    """
    names = catalog_names(catalog)
    exact = names.groupBy("name").agg(F.max("sku").alias("exact_sku"))
    lines = names.groupBy("line").agg(F.count("*").alias("n"), F.min("sku").alias("line_sku")).where("n = 1 and line != ''").select("line", "line_sku")
    starts = beginnings(names).groupBy("start").agg(F.count("*").alias("n"), F.min("sku").alias("start_sku")).where("n = 1").select("start", "start_sku")
    m = models.withColumn("bare", F.regexp_replace("model", " 2026$", ""))
    out = (
        m.join(exact.withColumnsRenamed({"name": "model"}).select("model", F.lit(True).alias("named")), "model", "left")
        .join(exact.withColumnRenamed("name", "bare"), "bare", "left")
        .join(lines.withColumnRenamed("line", "model"), "model", "left")
        .join(starts.withColumnRenamed("start", "model"), "model", "left")
    )
    return out.where("named is null").select(F.col("model").alias("alias_normalizado"), F.coalesce("exact_sku", "line_sku", "start_sku").alias("sku")).where("sku is not null")


def build_fuzzy_matches(models: DataFrame, catalog: DataFrame, aliases: DataFrame, score: float = SCORE, margin: float = MARGIN) -> DataFrame:
    """The two nearest catalogue names of each model that neither is one nor has an alias, and a decision.

    {modelo_interes_normalizado, top_1, top_1_score, top_2, top_2_score, margin, decision, sku}. Ties keep
    catalogue order; a name that two rows share is two names, so nothing that is nearest to it has a lead. sku is that
    of top_1, whatever the decision. AMBIGUOUS where the model is a brand or begins several names; MATCHED from `score` on
    with a lead of `margin`; else REVIEW. Without a second name its score is 0. Nearest names come from
    similarity.nearest: every pair that could be among them is compared, the others are ruled out by bounds.
    """
    names = materialise(catalog_names(catalog), "catalogue-names")
    rest = models.join(names.select(F.col("name").alias("model")), "model", "left_anti").join(aliases.select(F.col("alias_normalizado").alias("model")), "model", "left_anti")
    found = nearest(rest.select(F.col("model").alias("key")), names.select(F.col("sku").alias("id"), "name"), 2)
    at = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    two = found.groupBy("key").agg(at(1, "name").alias("top_1"), at(1, "score").alias("s1"), at(2, "name").alias("top_2"), F.coalesce(at(2, "score"), F.lit(0.0)).alias("s2"), at(1, "id").alias("sku"))
    brands = names.select(F.col("brand").alias("key")).distinct().withColumn("is_brand", F.lit(True))
    begins = beginnings(names).groupBy(F.col("start").alias("key")).agg(F.count(F.lit(1)).alias("begins"))
    told = two.join(brands, "key", "left").join(begins, "key", "left").withColumn("lead", F.col("s1") - F.col("s2"))
    unclear = F.coalesce("is_brand", F.lit(False)) | (F.coalesce("begins", F.lit(0)) > 1)
    decision = F.when(unclear, "AMBIGUOUS").when((F.col("s1") >= score) & (F.col("lead") >= margin), "MATCHED").otherwise("REVIEW")
    return told.select(F.col("key").alias("modelo_interes_normalizado"), "top_1", F.round("s1", 4).alias("top_1_score"), "top_2", F.round("s2", 4).alias("top_2_score"), F.round("lead", 4).alias("margin"), decision.alias("decision"), "sku")


def catalog_availability(catalog: DataFrame) -> DataFrame:
    """Distinct {sku, punto_venta_id} of the stores listed for each sku."""
    store = F.explode(F.split("puntos_venta_disponibles_raw", r"\|"))
    return catalog.select("sku", store.alias("p")).select("sku", F.trim("p").alias("punto_venta_id")).where("punto_venta_id != ''").distinct()


def lead_model_match(leads: DataFrame, catalog: DataFrame, aliases: DataFrame, fuzzy: DataFrame, availability: DataFrame) -> DataFrame:
    """The sku of each lead with how it was found, its catalogue attributes and whether its store has it. [raw_row_id]

    match_score is kept for names that stay AMBIGUOUS or in REVIEW though they get no sku.
    """
    model = "modelo_interes_normalizado"
    exact = catalog.where("modelo_normalizado is not null").groupBy(F.col("modelo_normalizado").alias(model)).agg(F.min("sku").alias("exact_sku"))
    alias = aliases.select(F.col("alias_normalizado").alias(model), F.col("sku").alias("alias_sku"))
    near = fuzzy.select(model, "decision", F.col("top_1_score").alias("near_score"), F.when(F.col("decision") == "MATCHED", F.col("sku")).alias("near_sku"))
    keys = leads.select("raw_row_id", "lead_id", "empresa_id", "punto_venta_id", model)
    found = keys.join(exact, model, "left").join(alias, model, "left").join(near, model, "left").withColumn("sku", F.coalesce("exact_sku", "alias_sku", "near_sku"))
    attributes = catalog.select("sku", "modelo_canonico", "marca_normalizada", "linea_normalizada", "precio_lista")
    there = availability.withColumn("there", F.lit(True))
    status = F.when(F.col(model).isNull(), "MISSING").when(F.col("sku").isNotNull(), "MATCHED").otherwise(F.coalesce("decision", F.lit("UNMATCHED")))
    method = F.when(F.col("exact_sku").isNotNull(), "normalized_exact").when(F.col("alias_sku").isNotNull(), "alias").when(F.col("decision").isNotNull(), "fuzzy").otherwise("none")
    score = F.when(F.col("exact_sku").isNotNull() | F.col("alias_sku").isNotNull(), 1.0).otherwise(F.col("near_score"))
    return (
        found.join(attributes, "sku", "left").join(there, ["sku", "punto_venta_id"], "left")
        .select(
            "raw_row_id", "lead_id", "empresa_id", "punto_venta_id", model, "sku", "modelo_canonico", "marca_normalizada", "linea_normalizada", "precio_lista",
            method.alias("match_method"), score.alias("match_score"), status.alias("match_status"),
            F.when(F.col("sku").isNotNull() & F.col("punto_venta_id").isNotNull(), F.coalesce("there", F.lit(False))).alias("is_available_at_store"),
        )
    )
