"""Adjustment of raw classifier outputs by the words of the full prompt."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight import fixed_values as V
from wardlight.functions.text import any_match, any_of


def _label(raw: Column) -> Column:
    return F.upper(raw["label"])


def toxic_score(lowered: Column, raw: Column) -> Column:
    """``raw`` is struct<label, score>; a missing output scores 0."""
    score = raw["score"]
    other = 1.0 - score
    return (
        F.when(score.isNull() | raw["label"].isNull(), 0.0)
        .when(
            _label(raw) == "TOXIC",
            F.when((score > 0.01) & any_of(lowered, V.TOXIC_WORDS), F.least(score * 8.0, F.lit(0.9))).otherwise(score),
        )
        .when((other < 0.6) & any_match(lowered, V.TOXIC_PATTERNS), 0.6)
        .otherwise(other)
    )


def hate_score(lowered: Column, raw: Column) -> Column:
    score = raw["score"]
    other = 1.0 - score
    return (
        F.when(score.isNull() | raw["label"].isNull(), 0.0)
        .when(
            _label(raw) == "TOXIC",
            F.when((score > 0.1) & any_of(lowered, V.HATE_WORDS), F.least(score * 3.0, F.lit(0.9))).otherwise(score),
        )
        .when((other < 0.5) & any_match(lowered, V.HATE_PATTERNS), 0.5)
        .otherwise(other)
    )


def safety_score(lowered: Column, raw: Column) -> Column:
    score = raw["score"]
    negative = (
        F.when((score > 0.8) & any_of(lowered, V.SAFETY_ATTACK_WORDS), F.least(score * 0.7, F.lit(0.8)))
        .when((score > 0.5) & any_of(lowered, V.SAFETY_NEGATIVE_WORDS), F.least(score * 0.5, F.lit(0.6)))
        .when(score > 0.9, F.least(score * 0.3, F.lit(0.4)))
        .otherwise(F.least(score * 0.1, F.lit(0.2)))
    )
    positive = F.when(
        any_of(lowered, V.SAFETY_POSITIVE_WORDS), F.least((1.0 - score) * 0.3, F.lit(0.3))
    ).otherwise(F.least((1.0 - score) * 0.05, F.lit(0.1)))
    return (
        F.when(score.isNull() | raw["label"].isNull(), 0.0)
        .when(any_match(lowered, V.SAFETY_PATTERNS), 0.8)
        .when(_label(raw) == "NEGATIVE", negative)
        .otherwise(positive)
    )
