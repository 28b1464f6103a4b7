"""Vote layers on a full score grid, reasons and the older vote."""

import itertools

from pyspark.sql import functions as F

from wardlight import fixed_values as V
from wardlight.functions import legacy, voting


def by_hand(mode, k, t, h, s):
    high, weak, count, _, weighted, weights = V.MODES.get(mode, V.MODES["balanced"])
    scores = [k, t, h, s]
    if k > high or t > 0.6 or h > 0.5 or s > high:
        return "high_confidence_trigger", V.REASON_HIGH_CONFIDENCE
    if sum(x > weak for x in scores) >= count:
        return "weak_signals_trigger", V.REASON_WEAK_SIGNALS
    if sum(x > 0.5 for x in scores) >= 2:
        return "majority_consensus", V.REASON_MAJORITY
    total = 0.0
    for x, w in zip(scores, weights):
        total += x * w
    if total > weighted:
        return "weighted_ensemble", V.REASON_WEIGHTED % total
    return "none", V.REASON_SAFE


def test_grid(spark):
    steps = [i / 20 for i in range(0, 21, 2)] + [0.25, 0.525, 0.575]
    grid = list(itertools.product(["high", "balanced", "conservative", "unknown"], steps, steps, steps, steps[:9]))
    df = spark.createDataFrame(grid, "mode string, keyword_score double, toxic_score double, hate_score double, safety_score double")
    voted = voting.with_vote(df.withColumn("_settings", voting.mode_settings(F.col("mode"))))
    rows = voted.select(*df.columns, "mechanism", "reason", "is_adversarial").collect()
    assert len(rows) == len(grid)
    seen = set()
    for r in rows:
        mechanism, reason = by_hand(*r[:5])
        assert (r["mechanism"], r["reason"], r["is_adversarial"]) == (mechanism, reason, mechanism != "none"), r
        seen.add((r["mode"], mechanism))
    assert ("high", "weighted_ensemble") in seen and ("conservative", "majority_consensus") in seen


def test_reason_rounds_like_printf(spark):
    values = [0.3125, 0.3005, 0.3015, 0.4375, 0.0625, 0.5555, 0.3999999, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "w double")
    got = [r[0] for r in df.select(voting.vote_reason(F.lit("weighted_ensemble"), F.col("w"))).collect()]
    assert got == [V.REASON_WEIGHTED % v for v in values]


def legacy_by_hand(scores):
    votes = int(scores[0] > 0.5)
    for i in (1, 2, 3):
        if scores[i] > 0.5:
            return True, V.LEGACY_REASON_CONFIDENT % i, 0
        votes += scores[i] > 0.4
    if votes > 1:
        return True, V.LEGACY_REASON_MAJORITY, votes
    return False, V.LEGACY_REASON_NONE, votes


def test_legacy_grid(spark):
    steps = [0.0, 0.4, 0.41, 0.5, 0.51, 1.0]
    grid = list(itertools.product(steps, repeat=4))
    df = spark.createDataFrame(grid, "a double, b double, c double, d double")
    rows = df.withColumns(legacy.legacy_vote([F.col(c) for c in "abcd"])).collect()
    for r in rows:
        assert (r["is_adversarial"], r["reason"], r["model_agreement"]) == legacy_by_hand(r[:4])


def test_unknown_legacy_model_scores_zero(spark):
    df = spark.createDataFrame([([("toxic", 0.9)],)], "o array<struct<label: string, score: double>>")
    models = [*V.LEGACY_MODELS, "other"]
    row = df.select(*[legacy.legacy_score(m, F.col("o")).alias(m) for m in models]).first()
    assert row.asDict() == {"electra_small": 0.0, "tox_bert": 0.9, "offensive_roberta": 0.0, "bart_mnli": 0.0, "other": 0.0}
