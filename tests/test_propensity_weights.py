"""The regression goes over different rows with weights, not over all rows."""

import random

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression

from leadflow.operators import propensity


def test_weighted_rows_fit_as_all_rows_do(spark, monkeypatch):
    rng = random.Random(3)
    kinds = [(f"E{rng.randrange(3)}", f"PV-{rng.randrange(4):03d}", rng.choice(["whatsapp", None]), "m", float(rng.choice([100, 200, 350])), rng.random() < 0.5, None) for _ in range(30)]
    rows = [(*rng.choice(kinds), float(rng.random() < 0.3)) for _ in range(900)]
    train = spark.createDataFrame(rows, "empresa_id string, punto_venta_id string, canal_normalizado string, modelo_feature string, precio_lista double, manifesto_cuota_inicial boolean, pidio_cita boolean, label double").cache()
    seen = []
    build = propensity.build_regression

    class Watched(LogisticRegression):
        def fit(self, df):
            seen.append(df.count())
            return super().fit(df)

    monkeypatch.setattr(propensity, "build_regression", lambda n: Watched(**{p.name: v for p, v in build(n).extractParamMap().items()}))
    model = propensity.fit_propensity(train)
    assert len(seen) == 1 and seen[0] <= 60  # of 900
    ready = propensity._prepared(train, model.price, model.modes)
    whole = Pipeline(stages=[*propensity.build_features().getStages(), LogisticRegression(regParam=1.0 / 900, elasticNetParam=0.0, standardization=False, maxIter=1000, tol=1e-8)]).fit(ready)
    one, other = model.pipeline.stages[-1], whole.stages[-1]
    assert max(abs(a - b) for a, b in zip(one.coefficients.toArray(), other.coefficients.toArray())) < 1e-4 and abs(one.intercept - other.intercept) < 1e-4
