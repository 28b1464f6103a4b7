"""Sensitivity modes and the four-layer vote over the scores (keyword, toxic, hate, safety)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as V

SETTINGS = [
    "high_confidence_threshold", "weak_signals_threshold", "weak_signals_count", "majority_threshold",
    "weighted_threshold", "keyword_weight", "toxic_weight", "hate_weight", "safety_weight",
]


def _values(mode: str) -> list[float]:
    *head, weights = V.MODES[mode]
    return [*head, *weights]


def mode_settings(mode: Column | str | None = None) -> Column:
    """Struct of settings for a mode name; an unknown or missing name means the default mode.

    Three rows of constants are an expression, not a join.
    """
    def struct(name: str) -> Column:
        return F.struct(*[F.lit(v).alias(k) for k, v in zip(SETTINGS, _values(name))])

    if mode is None or isinstance(mode, str):
        return struct(mode if mode in V.MODES else V.DEFAULT_MODE)
    chosen = None
    for name in V.MODES:
        if name != V.DEFAULT_MODE:
            chosen = (F if chosen is None else chosen).when(mode == name, struct(name))
    return chosen.otherwise(struct(V.DEFAULT_MODE))


def all_modes() -> Column:
    """Array of the mode names, for exploding every prompt over every mode."""
    return F.array(*[F.lit(name) for name in V.MODES])


def vote_layers(keyword: Column, toxic: Column, hate: Column, safety: Column, s: Column) -> dict[str, Column]:
    """The four layers as independent booleans plus the weighted sum.  All comparisons are strict."""
    scores = [keyword, toxic, hate, safety]

    def above(limit: Column) -> Column:
        return sum(((x > limit).cast("int") for x in scores), F.lit(0))

    weighted = (
        (keyword * s["keyword_weight"] + toxic * s["toxic_weight"]) + hate * s["hate_weight"]
    ) + safety * s["safety_weight"]
    return {
        "high": (keyword > s["high_confidence_threshold"])
        | (toxic > V.TOXIC_CUTOFF)
        | (hate > V.HATE_CUTOFF)
        | (safety > s["high_confidence_threshold"]),
        "weak": above(s["weak_signals_threshold"]) >= s["weak_signals_count"],
        "majority": above(F.lit(V.MODEL_THRESHOLD)) >= 2,
        "weighted": weighted > s["weighted_threshold"],
        "weighted_score": weighted,
    }


def with_vote(df: DataFrame, settings: str = "_settings") -> DataFrame:
    """Add ``mechanism`` (first layer that fires, or ``none``), ``is_adversarial`` and ``reason``."""
    names = [F.col(f"{m}_score") for m in V.SCORE_NAMES]
    layers = vote_layers(*names, F.col(settings))
    voted = df.withColumns({
        "mechanism": F.when(layers["high"], "high_confidence_trigger")
        .when(layers["weak"], "weak_signals_trigger")
        .when(layers["majority"], "majority_consensus")
        .when(layers["weighted"], "weighted_ensemble")
        .otherwise("none"),
        "_weighted": layers["weighted_score"],
    })
    return voted.withColumns({
        "is_adversarial": F.col("mechanism") != "none",
        "reason": vote_reason(F.col("mechanism"), F.col("_weighted")),
    }).drop("_weighted")


def vote_reason(mechanism: Column, weighted: Column) -> Column:
    """Reason text.  ``format_number`` rounds the exact binary value half-even, like C and Python do."""
    head, tail = V.REASON_WEIGHTED.split("%.3f")
    return (
        F.when(mechanism == "high_confidence_trigger", V.REASON_HIGH_CONFIDENCE)
        .when(mechanism == "weak_signals_trigger", V.REASON_WEAK_SIGNALS)
        .when(mechanism == "majority_consensus", V.REASON_MAJORITY)
        .when(mechanism == "weighted_ensemble", F.concat(F.lit(head), F.format_number(weighted, 3), F.lit(tail)))
        .otherwise(V.REASON_SAFE)
    )


def vote_details(mechanism: Column, early_exit: Column, error: Column, parallel: bool = False) -> Column:
    """Flags as logged: an early exit and an error use their own keys, keys that were not set are NULL."""
    voted = ~early_exit & ~error
    layers = ["high_confidence_trigger", "weak_signals_trigger", "majority_consensus", "weighted_ensemble"]
    flags = {name: F.when(voted, mechanism == name) for name in layers}
    if not parallel:
        flags["high_confidence_trigger"] = F.when(early_exit, True).when(voted, mechanism == layers[0])
    flags["early_exit"] = F.when(early_exit, True) if not parallel else F.lit(None).cast("boolean")
    flags["error"] = F.when(error, True)
    flags["fallback"] = F.when(error, True)
    decision = F.when(voted, F.when(mechanism == "none", "safe").otherwise("adversarial"))
    return F.struct(*[c.alias(k) for k, c in flags.items()], decision.alias("final_decision"))


def winning_mechanism(mechanism: Column, early_exit: Column, error: Column, parallel: bool = False) -> Column:
    """First true key: an early exit counts as high confidence, or has no details at all in the parallel form."""
    early = F.lit(None).cast("string") if parallel else F.lit("high_confidence_trigger")
    return F.when(early_exit, early).when(error, "error").otherwise(mechanism)
