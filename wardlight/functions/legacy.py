"""The older four-model ensemble: score extraction from all-label outputs, and its vote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlight import fixed_values as V


def score_of(outputs: Column, label: str) -> Column:
    """Score of the first entry with ``label`` in array<struct<label, score>>, else 0."""
    found = F.filter(outputs, lambda o: o["label"] == label)
    return F.coalesce(F.get(found, F.lit(0))["score"], F.lit(0.0))


def sum_of(outputs: Column, labels: list[str]) -> Column:
    wanted = F.filter(outputs, lambda o: o["label"].isin(labels))
    return F.coalesce(F.aggregate(wanted, F.lit(0.0), lambda acc, o: acc + o["score"]), F.lit(0.0))


def legacy_score(model: str, outputs: Column) -> Column:
    """Score of one named model; unknown names and missing outputs give 0.

    The zero-shot model takes the second entry by position, whatever its label is.
    """
    if model == "electra_small":
        return score_of(outputs, "LABEL_1")
    if model == "tox_bert":
        return sum_of(outputs, ["toxic", "threat", "identity_hate"])
    if model == "offensive_roberta":
        return score_of(outputs, "offensive")
    if model == "bart_mnli":
        return F.coalesce(F.get(outputs, F.lit(1))["score"], F.lit(0.0))
    return F.lit(0.0)


def legacy_vote(scores: list[Column], threshold: float = V.MODEL_THRESHOLD) -> dict[str, Column]:
    """Decision, reason, votes (0 when a model was confident on its own) and confidence."""
    first, others = scores[0], scores[1:]
    confident = F.lit(0)
    for i in range(len(others), 0, -1):
        confident = F.when(others[i - 1] > threshold, i).otherwise(confident)
    votes = (first > threshold).cast("int") + sum(((s > 0.4).cast("int") for s in others), F.lit(0))
    return {
        "is_adversarial": (confident > 0) | (votes > 1),
        "reason": F.when(confident > 0, F.format_string(V.LEGACY_REASON_CONFIDENT, confident))
        .when(votes > 1, V.LEGACY_REASON_MAJORITY)
        .otherwise(V.LEGACY_REASON_NONE),
        "electra_vote": first > threshold,
        "model_agreement": F.when(confident > 0, 0).otherwise(votes).cast("bigint"),
        "confidence_score": F.greatest(*scores),
    }
