"""Classifier evaluation: metrics, curves, calibration, checkpoints, leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.operators.ordered import running

EPSILON = 1e-12


def softmax_positive(logit0: Column, logit1: Column) -> Column:
    return F.exp(logit1) / (F.exp(logit0) + F.exp(logit1))


def argmax_class(logit0: Column, logit1: Column) -> Column:
    """Index of the larger logit; the first on ties."""
    return F.when(logit1 > logit0, 1).otherwise(0)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2.0 * precision * recall / (precision + recall)).otherwise(0.0)


def binary_metrics(df: DataFrame, y: str = "y", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of class 1; zero where a denominator is zero."""
    truth, guess = F.col(y) == 1, F.col(predicted) == 1
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(~truth & ~guess).alias("tn"),
    )
    tp = F.col("tp")
    scored = counts.withColumns({
        "accuracy": _ratio(tp + F.col("tn"), tp + F.col("fp") + F.col("fn") + F.col("tn")),
        "precision": _ratio(tp, tp + F.col("fp")),
        "recall": _ratio(tp, tp + F.col("fn")),
    })
    return scored.withColumn("f1", _f1(F.col("precision"), F.col("recall"))).drop("tp", "fp", "fn", "tn")


def macro_metrics(df: DataFrame, y: str = "y", predicted: str = "predicted") -> DataFrame:
    """Unweighted means over the classes that occur as truth or prediction, plus accuracy."""
    hit = (F.col(y) == F.col(predicted)).cast("int")
    sides = df.select(F.explode(F.array(
        F.struct(F.col(y).alias("cls"), hit.alias("tp"), F.lit(0).alias("guessed"), F.lit(1).alias("actual")),
        F.struct(F.col(predicted).alias("cls"), F.lit(0).alias("tp"), F.lit(1).alias("guessed"), F.lit(0).alias("actual")),
    )).alias("s"))
    per_class = sides.groupBy("s.cls").agg(
        F.sum("s.tp").alias("tp"), F.sum("s.guessed").alias("guessed"), F.sum("s.actual").alias("actual")
    ).withColumns({
        "precision": _ratio(F.col("tp"), F.col("guessed")),
        "recall": _ratio(F.col("tp"), F.col("actual")),
    }).withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    return per_class.agg(
        F.round(F.sum("tp") / F.sum("actual"), 9).alias("accuracy"),
        F.round(F.avg("precision"), 9).alias("precision"),
        F.round(F.avg("recall"), 9).alias("recall"),
        F.round(F.avg("f1"), 9).alias("f1"),
    )


def pr_curve(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall and F1 at every distinct score used as threshold (prediction: p >= threshold)."""
    by_score = df.groupBy(F.col(p).alias("threshold")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(y) == 1).alias("_tp")
    )
    upto = running(by_score, [F.col("threshold").desc()], {"n": F.col("_n"), "tp": F.col("_tp")})
    positives = df.agg(F.count_if(F.col(y) == 1).alias("k")).scalar()
    rated = upto.select(
        "threshold",
        (F.col("tp") / F.col("n")).alias("precision"),
        F.when(positives > 0, F.col("tp") / positives).otherwise(1.0).alias("recall"),
    )
    both = F.col("precision") + F.col("recall")
    return rated.withColumn("f1", 2.0 * F.col("precision") * F.col("recall") / (both + EPSILON))


def best_threshold(curve: DataFrame) -> DataFrame:
    """Row with the largest F1, the lowest threshold on ties."""
    return curve.orderBy(F.col("f1").desc(), "threshold").limit(1)


def metrics_at_threshold(df: DataFrame, threshold: Column, y: str = "y", p: str = "p") -> DataFrame:
    return binary_metrics(df.withColumn("predicted", (F.col(p) >= threshold).cast("int")), y)


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("s")).scalar()
    return counted.select(label, "n", (whole["n"] / (whole["k"] * F.col("n"))).alias("weight"))


def best_checkpoints(log: DataFrame, run: str = "run", step: str = "step", f1: str = "f1") -> DataFrame:
    """Flag evaluations that beat every earlier one of their run (and zero)."""
    seen = running(log, [F.col(step)], {"_best": F.col(f1)}, [run], how="max", inclusive=False)
    better = F.coalesce(F.col(f1) > F.greatest(F.coalesce(F.col("_best"), F.lit(0.0)), F.lit(0.0)), F.lit(False))
    return seen.withColumn("should_save", better).drop("_best")


def leaderboard(runs: DataFrame, metric: str = "f1") -> DataFrame:
    """Runs with a ``config`` and a ``summary`` map, best metric first, runs without it last."""
    measures = ["accuracy", "f1", "precision", "recall"]
    return runs.select(
        "name",
        F.coalesce(F.try_element_at("config", F.lit("model")), F.lit("unknown")).alias("model"),
        *[F.try_element_at("summary", F.lit(m)).alias(m) for m in measures],
        "url",
    ).orderBy(F.col(metric).desc_nulls_last(), "name")
