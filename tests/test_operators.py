import random

import pytest
from pyspark.sql import functions as F

from leadflow.operators import conversations as C
from leadflow.operators import evaluation, facts, identity, knowledge, matching, merge, priority, propensity, quality
from leadflow.operators.components import connected_components
from leadflow.operators.ranking import global_rank
from leadflow.sources import files

PAYLOAD = "conversation_id string, modelo_interes string, presupuesto double, cuota_inicial double, forma_pago string, intencion string, objecion_principal string, pidio_cita boolean, pidio_cotizacion boolean, evidencia array<struct<campo:string,fragmento:string,emisor:string>>, mensajes array<struct<emisor:string,texto:string,hora:string>>"


def payload(spark, messages=(), evidence=(), **values):
    row = dict(conversation_id="c", modelo_interes=None, presupuesto=None, cuota_inicial=None, forma_pago="no_informa", intencion="media", objecion_principal=None, pidio_cita=False, pidio_cotizacion=False) | values
    return spark.createDataFrame([(*row.values(), list(evidence), [(e, t, None) for e, t in messages])], PAYLOAD)


def test_components_match_union_find(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(230)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 2000 + i) for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*pairs, (None, 3)], "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in pairs if a != b for x in (a, b)}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_end_when_only_stars_are_left(spark, tmp_path):
    """A round costs the driver a task for each shuffle partition and shuffle, so none is run to see that nothing changes."""
    spark.createDataFrame([(0, i) for i in range(1, 50)], "u long, v long").write.parquet(str(tmp_path / "edges"))
    sc = spark.sparkContext
    sc.setJobGroup("stars", "components of stars")
    try:
        assert connected_components(spark.read.parquet(str(tmp_path / "edges"))).where("component != 0").count() == 0
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    told = sc.statusTracker()
    stages = [told.getStageInfo(s) for j in told.getJobIdsForGroup("stars") for s in told.getJobInfo(j).stageIds]
    assert sum(1 for s in stages if s and s.numCompletedTasks) < 12


def test_global_rank(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") * 7919 % 13).alias("s"))
    got = global_rank(df, [F.col("s").desc()], [F.col("id").asc()], "r", buckets=5).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["r"])] == [r["id"] for r in sorted(got, key=lambda r: (-r["s"], r["id"]))]
    assert sorted(r["r"] for r in got) == list(range(1, 501))


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, best[j + 1] = best[j + 1], before + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_similarity_and_fuzzy(spark):
    models = spark.createDataFrame([("a k t nkd 125",), ("akt",), ("akt nkd 125",), ("akt nkd",)], "model string")
    catalog = spark.createDataFrame([("1", "AKT", "NKD 125"), ("2", "AKT", "TTR 200"), ("3", "Honda", "CB 190R")], "sku string, marca_raw string, linea_raw string")
    aliases = matching.build_aliases(models, catalog)
    assert {(r[0], r[1]) for r in aliases.collect()} == {("akt nkd", "1")}
    rows = {r["modelo_interes_normalizado"]: r for r in matching.build_fuzzy_matches(models, catalog, aliases).collect()}
    assert set(rows) == {"a k t nkd 125", "akt"}
    assert rows["akt"]["decision"] == "AMBIGUOUS" and rows["a k t nkd 125"]["decision"] == "MATCHED" and rows["a k t nkd 125"]["sku"] == "1"
    twice = catalog.unionByName(spark.createDataFrame([("0", "AKT", "NKD 125")], catalog.schema))
    row = {r["modelo_interes_normalizado"]: r for r in matching.build_fuzzy_matches(models, twice, aliases).collect()}["a k t nkd 125"]
    assert (row["margin"], row["decision"], row["sku"], row["top_2"]) == (0, "REVIEW", "0", "akt nkd 125")  # two rows of one name
    a, b = "a k t nkd 125", "akt nkd 125"
    assert rows[a]["top_1_score"] == round(2 * lcs(a, b) / (len(a) + len(b)), 4) == 0.9167


def test_identity_chain(spark):
    rows = [
        ("a", "1", "E1", "VALID", "+573", None, "web"), ("b", "2", "E1", "VALID", "+573", "x@y.co", "web"), ("c", "3", "E1", "MISSING", None, "x@y.co", "sms"),
        ("d", "4", "E2", "VALID", "+573", None, "web"), ("e", None, "E1", "MISSING", None, None, None), ("f", "6", None, "VALID", "+573", "x@y.co", None),
    ]
    leads = spark.createDataFrame(rows, "raw_row_id string, lead_id string, empresa_id string, telefono_parse_status string, telefono_normalizado string, email_normalizado string, canal_normalizado string")
    signals = identity.identity_signals(leads)
    got = {r["raw_row_id"]: r for r in identity.lead_identity_map(leads, signals).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert len({got[k]["customer_identity_id"] for k in "abc"}) == 1 and got["d"]["customer_identity_id"] != got["a"]["customer_identity_id"]
    assert got["a"]["identity_member_count"] == 3 and got["a"]["has_multiple_channels"] and not got["d"]["is_duplicate_identity"]
    assert [r["signal_type"] for r in identity.cross_company_signals(signals).collect()] == ["PHONE"]


def test_facts(spark):
    one = lambda df: facts.reconcile_explicit_facts(df).first()
    r = one(payload(spark, [("cliente", "Financiada, tengo 2000mil de inicial")]))
    assert (r["forma_pago"], r["cuota_inicial"]) == ("credito", 2_000_000)
    r = one(payload(spark, [("cliente", "De contado, ya tengo la plata lista, 6 palos")], cuota_inicial=5.0))
    assert (r["forma_pago"], r["presupuesto"], r["cuota_inicial"]) == ("contado", 6_000_000, None)
    r = one(payload(spark, [("cliente", "Era por curiosidad nomás"), ("asesor", "Le envío una cotización"), ("cliente", "Gracias, quedo pendiente")]))
    assert (r["intencion"], r["pidio_cotizacion"]) == ("baja", False)
    assert one(payload(spark, [("cliente", "¿Mañana los visito?")]))["pidio_cita"]
    r = one(payload(spark, [("asesor", "Te hago la cotización"), ("cliente", "Bueno, mándela")]))
    assert r["pidio_cotizacion"] and [e["campo"] for e in r["evidencia"]] == ["pidio_cotizacion"]
    assert one(payload(spark, [("asesor", "contado")]))["forma_pago"] == "no_informa"


def test_guard(spark):
    guard = lambda df: facts.enforce_customer_signal_evidence(df).first()
    r = guard(payload(spark, evidence=[("cuota_inicial", "2 millones", "asesor")], cuota_inicial=2e6, pidio_cotizacion=True, forma_pago="contado"))
    assert (r["cuota_inicial"], r["pidio_cotizacion"], r["forma_pago"]) == (None, False, "no_informa")
    r = guard(payload(spark, evidence=[("presupuesto", "6 palos", "cliente"), ("forma_pago", "contado", "cliente")], presupuesto=1.0, forma_pago="contado"))
    assert (r["presupuesto"], r["forma_pago"]) == (6_000_000, "contado")


def test_conversation_steps(spark):
    df = payload(spark, [("cliente", "Hola"), ("asesor", "Buenas")])
    assert df.select(C.render_conversation(F.col("mensajes"))).first()[0] == "CLIENTE: Hola\nASESOR: Buenas"
    with pytest.raises(Exception, match="no speaker"):
        payload(spark, [(None, "x")]).select(C.render_conversation(F.col("mensajes"))).collect()
    long = payload(spark, evidence=[("a", " ", "c"), ("a", "x" * 300, "c"), *[("b", str(i), "c") for i in range(6)]]).select(C.normalize_fragments(F.col("evidencia")).alias("e")).first()["e"]
    assert len(long) == 5 and len(long[0]["fragmento"]) == 240
    cases = spark.createDataFrame([(x,) for x in "ABCD"], "conversation_id string")
    answers = spark.createDataFrame([(x, True) for x in "ABBDX"], "conversation_id string, valid boolean")
    got = {r["conversation_id"]: (r["status"], r["error_type"]) for r in C.reconcile_responses(cases, answers).collect()}
    assert got == {"A": ("SUCCESS", None), "B": ("ERROR", "duplicate_response_id"), "C": ("ERROR", "missing_response_id"), "D": ("SUCCESS", None)}
    case = spark.createDataFrame([("A", "h")], "conversation_id string, conversation_hash string")
    log = spark.createDataFrame([("A", "h", "p", "v", "m", "ERROR")], "conversation_id string, conversation_hash string, semantic_prompt_hash string, batch_contract_version string, model_requested string, status string")
    plan = lambda **k: C.plan_cases(case, log, "p", "v", "m", **k).first()["plan_status"]
    assert (plan(), plan(retry_errors=True), plan(force=True)) == ("skipped_error", "pending", "skipped_error")
    with pytest.raises(ValueError):
        C.assign_batches(cases, 0)
    said = payload(spark, evidence=[("a", "ＨＯＬＡ  mundo", "cliente")]).withColumn("conversation_text", F.lit("CLIENTE: hola Mundo"))
    assert C.evidence_grounded(said).first()["evidence_grounded"]
    assert not C.evidence_grounded(said.withColumn("conversation_text", F.lit("otra"))).first()["evidence_grounded"]
    assert C.evidence_grounded(payload(spark).withColumn("conversation_text", F.lit(None).cast("string"))).first()["evidence_grounded"]


LEAD = "raw_row_id string, empresa_id string, punto_venta_id string, fecha_registro date, priority_score double"


def greedy(leads, advisors):
    taken, out = {}, {}
    for r in sorted(leads, key=lambda r: (-r[4], r[3] is None, r[3], r[0])):
        able = [a for a in advisors if a[3] and a[1:3] == (r[1], r[2])]
        free = [a for a in able if taken.get(a[0], 0) < (a[4] or 0)]
        if not free:
            out[r[0]] = (None, "UNASSIGNED_CAPACITY" if able else "NO_ELIGIBLE_ADVISOR")
            continue
        a = min(free, key=lambda a: (taken.get(a[0], 0) / a[4], taken.get(a[0], 0), a[0]))
        taken[a[0]] = taken.get(a[0], 0) + 1
        out[r[0]] = (a[0], "ASSIGNED")
    return out


def test_assignment_is_the_greedy_one(spark):
    rnd = random.Random(5)
    stores = [(e, p) for e in ("E1", "E2", None) for p in ("P1", "P2", None)]
    leads = [(f"{i:04d}", *rnd.choice(stores), None, float(rnd.randrange(5))) for i in range(400)]
    advisors = [(f"A{i:02d}", *rnd.choice(stores), rnd.random() < 0.8, rnd.choice([0, 1, 3, 7, 20, None])) for i in range(30)]
    a = spark.createDataFrame(advisors, "asesor_id string, empresa_id string, punto_venta_id string, activo boolean, capacidad_diaria_leads int")
    got = {r["raw_row_id"]: (r["advisor_id"], r["assignment_status"]) for r in priority.assign_leads(spark.createDataFrame(leads, LEAD), a).collect()}
    assert got == greedy(leads, advisors)


def test_priority_components(spark):
    base = dict(raw_row_id="a", fecha_registro=None, is_available_at_store=True, has_conversation=True, conversation_intencion="alta", conversation_pidio_cita=True, conversation_pidio_cotizacion=True, conversation_cuota_inicial=1.0, conversation_forma_pago="credito", propensity_score=0.5)
    schema = "raw_row_id string, fecha_registro date, is_available_at_store boolean, has_conversation boolean, conversation_intencion string, conversation_pidio_cita boolean, conversation_pidio_cotizacion boolean, conversation_cuota_inicial double, conversation_forma_pago string, propensity_score double"
    rows = [base, base | {"raw_row_id": "b", "conversation_cuota_inicial": 0.0, "is_available_at_store": None}, base | {"raw_row_id": "c", "conversation_forma_pago": "contado", "propensity_score": 0.9, "is_available_at_store": False}, base | {"raw_row_id": "d", "has_conversation": False, "propensity_score": None}]
    got = {r["raw_row_id"]: r for r in priority.score_leads(spark.createDataFrame([tuple(r.values()) for r in rows], schema), "2026-01-01").collect()}
    assert [got[k]["conversation_component"] for k in "abcd"] == [45, 38, 38, 0]
    assert [got[k]["availability_component"] for k in "abcd"] == [20, 8, 0, 20]
    assert [got[k]["propensity_percentile"] for k in "abcd"] == [0.0, 0.5, 1.0, None]
    ages = spark.createDataFrame([(x,) for x in (3.99, 4.0, 12.0, 24.0, 48.0)], "h double").select(priority.sla_component(F.col("h")).alias("p")).collect()
    assert [r["p"] for r in ages] == [0, 5, 10, 20, 30]
    assert got["a"]["priority_reasons"][0] == "Intención alta" and got["d"]["priority_reasons"] == ["Producto disponible"]


def test_upsert(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")], "k string, v int, kept string")
    u = spark.createDataFrame([("b", 20), ("c", 30), (None, 40)], "k string, v int")
    assert {tuple(r) for r in merge.upsert(t, u, ["k"], ["v"]).collect()} == {("a", 1, "x"), ("b", 20, "y"), ("c", 30, None), (None, 40, "z")}


def test_metrics(spark):
    rnd = random.Random(1)
    rows = [(f"{i}", rnd.randrange(8) / 8, float(rnd.random() < 0.3)) for i in range(300)]
    got = evaluation.evaluate_predictions(spark.createDataFrame(rows, "raw_row_id string, score double, label double")).first()
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    ap = tp = seen = 0
    for s in sorted({s for _, s, _ in rows}, reverse=True):
        p, n = sum(y for _, x, y in rows if x == s), sum(x == s for _, x, _ in rows)
        tp, seen = tp + p, seen + n
        ap += p * tp / seen
    assert got["roc_auc"] == pytest.approx(auc) and got["average_precision"] == pytest.approx(ap / len(pos))
    fields = "struct<modelo_interes:string,presupuesto:double,cuota_inicial:double,forma_pago:string,intencion:string,objecion_principal:string,pidio_cita:boolean,pidio_cotizacion:boolean>"
    good = ("Honda CB", 1000.0, None, "credito", "alta", None, True, False)
    rows = [("ok", good, ("hónda-cb", 1005.0, None, "credito", "alta", None, True, True), None, True, 1.0), ("error", good, None, "structured_output_invalid", None, 3.0)]
    m = evaluation.extraction_metrics(spark.createDataFrame(rows, f"status string, expected {fields}, actual {fields}, error_type string, evidence_grounded boolean, latency_seconds double")).first()
    assert m["macro_accuracy"] == 7 / 8 and m["macro_accuracy_end_to_end"] == 7 / 16 and m["success_rate"] == 0.5 and m["errors_by_type"] == {"structured_output_invalid": 1}


def test_golden(spark):
    names = ["conversation_id", "conversation_text", "modelo_interes", "presupuesto", "cuota_inicial", "forma_pago", "intencion", "objecion_principal", "pidio_cita", "pidio_cotizacion", "reviewed"]
    row = ["1", "t", " ", "5", "", "credito", "alta", "", "true", "FALSE", "true"]
    got = evaluation.golden_set(spark.createDataFrame([row, [*row[:-1], "false"]], names)).collect()
    assert len(got) == 1 and got[0]["modelo_interes"] is None and got[0]["presupuesto"] == 5 and got[0]["pidio_cita"] and not got[0]["pidio_cotizacion"]
    with pytest.raises(Exception, match="forma_pago"):
        evaluation.golden_set(spark.createDataFrame([[*row[:5], "trueque", *row[6:]]], names)).collect()


def test_knowledge(spark):
    text = "intro line\n# One\nalpha beta\n## Two\n\n### not a cut\ngamma\n# Empty\n\n# Last\nalpha"
    chunks = knowledge.markdown_chunks(spark.createDataFrame([("03_priority", text), ("none", "")], "stem string, text string"))
    rows = {r["slug"]: r for r in chunks.collect()}
    assert sorted(rows) == ["03_priority-01", "03_priority-02", "03_priority-03", "03_priority-04"]
    assert rows["03_priority-01"]["title"] == "03 Priority" and rows["03_priority-03"]["content"] == "### not a cut\ngamma"
    found = knowledge.search_chunks(chunks, spark.createDataFrame([("q", "Alpha beta"), ("z", "none at all")], "query_id string, query string"), 2).collect()
    assert [(r["slug"], r["tier"]) for r in sorted(found, key=lambda r: r["rank"])] == [("03_priority-02", 1), ("03_priority-04", 2)]
    loose = knowledge.search_chunks(chunks, spark.createDataFrame([("q", "gam"), ("r", "pha line")], "query_id string, query string"), 5).collect()
    assert sorted((r["query_id"], r["slug"], r["tier"]) for r in loose) == [("q", "03_priority-03", 3), ("r", "03_priority-01", 2), ("r", "03_priority-02", 3), ("r", "03_priority-04", 3)]


def test_quality_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    n = lambda r: r.first()["violations"]
    assert n(quality.not_null(df, "k")) == 1 and n(quality.unique(df, "k")) == 1 and n(quality.accepted_values(df, "v", [1, 2])) == 1
    assert n(quality.relationships(df, "k", df.where("v = 3"), "k")) == 2 and n(quality.same_grain(df, df.limit(0), "v")) == 3


def test_propensity(spark):
    rnd = random.Random(2)
    rows = [(f"{i}", "l", f"2026-01-{1 + i % 28:02d}", f"E{i % 3}", "P", rnd.choice(["web", None]), rnd.choice("ab"), rnd.choice([1.0, 5.0, None]), rnd.choice([True, None]), i % 2 == 0, rnd.choice(["cerrado", "perdido"])) for i in range(200)]
    schema = "raw_row_id string, lead_id string, fecha_registro string, empresa_id string, punto_venta_id string, canal_normalizado string, modelo_feature string, precio_lista double, manifesto_cuota_inicial boolean, pidio_cita boolean, desenlace_normalizado string"
    df = propensity.target_from_outcome(spark.createDataFrame(rows, schema).withColumn("fecha_registro", F.col("fecha_registro").cast("date")))
    train, test, cutoff = propensity.temporal_split(df)
    assert train.agg(F.max("fecha_registro")).first()[0] == cutoff < test.agg(F.min("fecha_registro")).first()[0]
    model = propensity.fit_propensity(train)
    new = df.limit(3).withColumn("modelo_feature", F.lit("never seen"))
    assert all(0 <= r["propensity_score"] <= 1 for r in propensity.score_serving(model, new, "v", "h", "2026-02-01").collect())
    assert len(model.levels) == len(model.pipeline.stages[-1].coefficients)
    with pytest.raises(ValueError):
        propensity.score_serving(model, new, "", "h", "2026-02-01")
    with pytest.raises(Exception, match="unexpected outcome"):
        propensity.target_from_outcome(df.drop("label").withColumn("desenlace_normalizado", F.lit("sin gestion"))).collect()
    assert propensity.dataset_hash(df).first() == propensity.dataset_hash(df.repartition(7)).first()


def test_ingestion(spark, tmp_path):
    for name, columns in files.CONTRACTS.items():
        line = ",".join(f"v{i}" for i in range(len(columns)))
        (tmp_path / f"{name}.csv").write_text("﻿" + ",".join(columns) + ",extra\n" + f"{line},x\n{line},x\n", encoding="utf-8")
    with pytest.raises(Exception):
        files.ingest(spark, str(tmp_path))
    (tmp_path / "conversations.json").write_text('[{"conversacion_id": "1", "lead_id": "2", "canal": null, "fecha_inicio": "x", "mensajes": [{"emisor": "cliente", "texto": "hola", "hora": "1"}]}]')
    first = files.ingest(spark, str(tmp_path))
    assert {(r["status"], r["files"], r["rows"]) for r in first.summary.collect()} == {("LOADED", 5, 9)}
    leads = first.tables["leads"].orderBy("source_row_number").collect()
    assert [r["source_row_number"] for r in leads] == [2, 3] and "extra" in leads[0]["raw_payload"] and leads[0]["raw_row_id"] != leads[1]["raw_row_id"]
    assert first.tables["conversations"].first()["mensajes"][0]["texto"] == "hola"
    assert {r["status"] for r in files.ingest(spark, str(tmp_path), first.manifest).summary.collect()} == {"SKIPPED"}
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="missing"):
        files.read_csv_source(spark, str(tmp_path / "bad.csv"), ["a", "c"])
    (tmp_path / "bad.json").write_text('[{"conversacion_id": "1"}]')
    with pytest.raises(ValueError):
        files.read_conversations(spark, str(tmp_path / "bad.json"))
