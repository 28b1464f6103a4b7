"""End-to-end prompt scoring: rules, early exit, classifiers, vote, decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight import fixed_values as V
from wardlight.functions import classifiers, voting
from wardlight.functions.rules import RuleSet, with_keyword_score
from wardlight.functions.text import any_of

MODEL_INPUT_CHARS = V.MODEL_INPUT_CHARS
RAW_COLUMNS = ["toxic", "hate", "safety"]
Scorer = Callable[[Column], Column]


def with_early_exit(df: DataFrame) -> DataFrame:
    return df.withColumn("early_exit", F.col("keyword_score") > V.EARLY_EXIT_THRESHOLD)


def with_scores(
    prompts: DataFrame,
    scorers: dict[str, Scorer] | None = None,
    rules: RuleSet | None = None,
    text: str = "prompt",
    failed: Column | None = None,
    input_chars: int | None = None,
    on_failure: str = "score",
) -> DataFrame:
    """The four scores, ``early_exit`` and ``error``; early exits and failed prompts have the keyword score only.

    ``input_chars`` is how much of a text the models read (None: all of it; ``MODEL_INPUT_CHARS`` is the first 512).  A scorer that gives no output for a
    prompt, as ``batch_scorer`` does where its model fails, scores 0 (``on_failure="score"``) or sends the prompt to the
    fallback (``"fallback"``).
    """
    if on_failure not in ("score", "fallback"):
        raise ValueError("on_failure is 'score' or 'fallback'")
    df = with_early_exit(with_keyword_score(prompts, text, rules))
    broken = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    if scorers:
        whole = F.coalesce(F.col(text), F.lit(""))
        cut = whole if input_chars is None else F.substring(whole, 1, input_chars)
        df = df.withColumn("_input", F.when(~F.col("early_exit"), cut))
        df = df.withColumns({name: fn(F.col("_input")) for name, fn in scorers.items()}).drop("_input")
        if on_failure == "fallback":
            for name in scorers:
                broken = broken | F.col(f"{name}.score").isNull()
    error = broken & ~F.col("early_exit")
    df = df.withColumn("error", error)
    lowered, skip = F.col("_lowered"), F.col("early_exit") | F.col("error")
    return df.withColumns({
        "toxic_score": F.when(skip, 0.0).otherwise(classifiers.toxic_score(lowered, F.col("toxic"))),
        "hate_score": F.when(skip, 0.0).otherwise(classifiers.hate_score(lowered, F.col("hate"))),
        "safety_score": F.when(skip, 0.0).otherwise(classifiers.safety_score(lowered, F.col("safety"))),
    }).drop("_lowered", *RAW_COLUMNS)


def score_prompts(
    prompts: DataFrame,
    mode: str | Column | None = None,
    scorers: dict[str, Scorer] | None = None,
    rules: RuleSet | None = None,
    parallel: bool = False,
    text: str = "prompt",
    failed: Column | None = None,
    input_chars: int | None = None,
    on_failure: str = "score",
) -> DataFrame:
    """Decide every prompt of a table or stream; one pass, no shuffle.

    ``prompts`` holds the raw classifier outputs as struct<label, score> columns ``toxic``, ``hate`` and
    ``safety``, or ``scorers`` maps these names to functions from a text column to such a struct (see
    ``batch_scorer``).  Early-exit prompts never reach a scorer: it gets NULL for them, which it has to pass
    through, so the rules are evaluated once and not once per branch.

    ``failed`` marks rows whose models broke down: these fall back to the keyword score alone.  See ``with_scores`` for
    ``input_chars`` and ``on_failure``.
    ``parallel`` selects the texts of the parallel form of the detector; the scores are the same.
    """
    df = with_scores(prompts, scorers, rules, text, failed, input_chars, on_failure).withColumn("_settings", voting.mode_settings(mode))
    return decide(voting.with_vote(df), parallel).drop("_settings")


def compare_modes(prompts: DataFrame, parallel: bool = False,
                  before: Callable[[DataFrame], DataFrame] | None = None, **options) -> DataFrame:
    """Every prompt under every sensitivity mode.  Rules and models run once per prompt, before the explode.

    ``before`` is applied to the scored rows before they are exploded, for columns that need the text once.
    """
    scored = with_scores(prompts, **options)
    each = (before(scored) if before else scored).withColumn("mode", F.explode(voting.all_modes()))
    each = each.withColumn("_settings", voting.mode_settings(F.col("mode")))
    return decide(voting.with_vote(each), parallel).drop("_settings")


def batch_scorer(load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]) -> Scorer:
    """Turn a model into a scorer.  ``load`` runs once per task and returns a function from a list of texts to
    (label, score) pairs; Arrow batches go in, NULL texts are left out and stay NULL.

    A failing model never ends the job: a batch that it cannot score is asked for text by text, and the texts that fail
    alone have ``error`` in place of label and score.  Where the model cannot be loaded all texts have it.
    """

    @F.pandas_udf("label string, score double, error string")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict, broken = None, None
        try:
            predict = load()
        except Exception as failure:  # the model is the caller's: whatever it raises is recorded in the rows
            broken = _message(failure)
        for texts in batches:
            known = texts.dropna()
            rows = [(None, None, broken)] * len(known) if predict is None else _predicted(predict, known.tolist())
            found = pd.DataFrame(rows, index=known.index, columns=["label", "score", "error"])
            yield found.reindex(texts.index).astype({"label": object, "score": "float64", "error": object})

    return score


def _message(failure: Exception) -> str:
    return f"{type(failure).__name__}: {failure}"


def _predicted(predict: Callable, texts: list[str]) -> list[tuple]:
    """(label, score, error) per text: the whole batch at once, or text by text if that fails."""
    try:
        pairs = list(predict(texts)) if texts else []
        if len(pairs) != len(texts):
            raise ValueError("the model gave another number of outputs than it got texts")
        return [(label, score, None) for label, score in pairs]
    except Exception as failure:
        if len(texts) == 1:
            return [(None, None, _message(failure))]
        return [row for one in texts for row in _predicted(predict, [one])]


def decide(df: DataFrame, parallel: bool = False) -> DataFrame:
    """Let early exits and errors override the vote, and add winning mechanism and details."""
    early, error = F.col("early_exit"), F.col("error")
    exit_text = V.REASON_EARLY_EXIT_PARALLEL if parallel else V.REASON_EARLY_EXIT
    return df.withColumns({
        "is_adversarial": F.when(early, True)
        .when(error, F.col("keyword_score") > V.FALLBACK_THRESHOLD)
        .otherwise(F.col("is_adversarial")),
        "reason": F.when(early, exit_text)
        .when(error, F.concat(F.lit(V.REASON_ERROR), F.lit("model failure")))
        .otherwise(F.col("reason")),
        "threshold": F.lit(V.MODEL_THRESHOLD),
        "winning_mechanism": voting.winning_mechanism(F.col("mechanism"), early, error, parallel),
        "voting_details": voting.vote_details(F.col("mechanism"), early, error, parallel),
    }).drop("mechanism")


def breakdown(df: DataFrame, latencies: dict[str, Column]) -> DataFrame:
    """Per-model scores and times, as the parallel detector returns them for prompts that took no early exit."""
    scores = F.struct(*[F.col(f"{m}_score").alias(m) for m in V.SCORE_NAMES])
    times = F.struct(*[c.alias(k) for k, c in latencies.items()])
    return df.withColumns({
        "model_breakdown": F.when(~F.col("early_exit"), scores),
        "timing_breakdown": F.when(~F.col("early_exit"), times),
    })


def basic_fallback(df: DataFrame, message: Column, text: str = "prompt") -> DataFrame:
    """Last resort when detection as a whole failed: one short word list."""
    hit = any_of(F.coalesce(F.lower(F.col(text)), F.lit("")), V.FALLBACK_WORDS)
    return df.withColumn("is_adversarial", hit).withColumns({
        "keyword_score": F.when(F.col("is_adversarial"), 0.8).otherwise(0.1),
        "toxic_score": F.lit(0.0),
        "hate_score": F.lit(0.0),
        "safety_score": F.lit(0.0),
        "reason": F.concat(
            F.when(F.col("is_adversarial"), V.REASON_FALLBACK_HIT).otherwise(V.REASON_FALLBACK_NONE), message
        ),
    })


def moderate(df: DataFrame, text: str = "prompt") -> DataFrame:
    """Reply per decision: the block text, or the pass-through text around the prompt."""
    head, tail = V.PASSED_REPLY.split("%s")
    passed = F.concat(F.lit(head), F.col(text), F.lit(tail))
    return df.withColumn("bot_response", F.when(F.col("is_adversarial"), V.BLOCKED_REPLY).otherwise(passed))
