"""Baseline model: the fitted weights minimise the balanced, regularised loss."""

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wardlight.operators.baseline import INVERSE_STRENGTH, Baseline
from wardlight.operators.dataprep import label_encode
from wardlight.operators.ngrams import TfIdf


def test_optimum_and_label_order(spark):
    rows = [(i, ("red apple " if i % 4 else "blue sky ") + "word" * (i % 3 + 1), "benign" if i % 4 else "adversarial")
            for i in range(80)]
    train = spark.createDataFrame(rows, "row_id bigint, prompt string, label string")
    model = Baseline(TfIdf(size=20)).fit(train)
    assert {r["label"]: r["label_id"] for r in model.labels.collect()} == {"adversarial": 0, "benign": 1}
    data = model.features.transform(label_encode(train)).select(vector_to_array("features").alias("x"), "label_id").toPandas()
    x, y = np.array(data["x"].tolist()), data["label_id"].to_numpy()
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    coef, bias = model.model.coefficients.toArray(), model.model.intercept
    residual = weight * (1 / (1 + np.exp(-(x @ coef + bias))) - y)
    assert np.abs(INVERSE_STRENGTH * x.T @ residual + coef).max() < 1e-2 and abs(residual.sum()) < 1e-2
    assert np.allclose(np.linalg.norm(x, axis=1), 1.0)
    row = model.evaluate(train, train).first()
    assert row["f1"] == 1.0
    scored = model.transform(train)
    assert scored.where((F.col("p") < 0) | (F.col("p") > 1)).count() == 0


def test_features_from_stored_grams(spark, monkeypatch):
    """Texts are read twice, and vocabulary and features are those of plain counts, where codes tell grams and where they collide."""
    from wardlight.operators import ngrams

    texts = [" ".join(f"w{j:03d}" for j in range(60) if i % (j + 1) == 0) for i in range(1, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id bigint, prompt string")
    every = ngrams.ngram_counts(df, 2).orderBy(F.desc("n"), "gram").collect()
    plain, cut = F.xxhash64, []
    monkeypatch.setattr(ngrams, "frequent_codes", lambda *a, f=ngrams.frequent_codes: cut.append(f(*a)) or cut[-1])
    for code in (plain, lambda *c: plain(*c) % 40):
        monkeypatch.setattr(ngrams.F, "xxhash64", code)
        model = TfIdf(size=9)
        fitted = model.fit_transform(df)
        assert model.vocabulary == sorted(r["gram"] for r in every[:9])
        assert "prompt" not in fitted.columns and fitted.count() == len(texts)
        again = {r["row_id"]: r["features"] for r in model.transform(df).collect()}
        assert {r["row_id"]: r["features"] for r in fitted.collect()} == again
    assert cut[0] is not None
