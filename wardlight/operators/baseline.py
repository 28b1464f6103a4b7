"""Baseline classifier (TF-IDF and balanced logistic regression) and batch scoring."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.operators.dataprep import label_encode, label_map
from wardlight.operators.evaluation import class_weights, macro_metrics
from wardlight.operators.ngrams import TfIdf
from wardlight.session import small_side

INVERSE_STRENGTH = 0.1
ITERATIONS = 1000


class Baseline:
    """fit / transform over (row_id, prompt, label) tables; label ids come from the train set."""

    def __init__(self, features: TfIdf | None = None):
        self.features = features or TfIdf()

    def fit(self, train: DataFrame) -> Baseline:
        self.labels = label_map(train)
        known = self.features.fit_transform(label_encode(train))
        weights = class_weights(known.select("label_id"), "label_id").select("label_id", "weight")
        rows = known.count()
        weighted = known.join(small_side(weights), "label_id").select("label_id", "weight", "features")
        # reg = 1 / (C * total weight); balanced weights sum to the number of rows
        self.model = LogisticRegression(
            featuresCol="features", labelCol="label_id", weightCol="weight", maxIter=ITERATIONS,
            regParam=1.0 / (INVERSE_STRENGTH * rows), elasticNetParam=0.0, standardization=False,
        ).fit(weighted)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(self.features.transform(df))
        return scored.withColumn("p", vector_to_array("probability")[1]).drop(
            "features", "rawPrediction", "probability"
        ).withColumn("prediction", F.col("prediction").cast("bigint"))

    def evaluate(self, test: DataFrame, train: DataFrame) -> DataFrame:
        encoded = label_encode(test, train)
        return macro_metrics(self.transform(encoded), "label_id", "prediction")
