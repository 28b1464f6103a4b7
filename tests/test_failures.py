"""Models that break down leave the job running."""

import pytest

from wardlight.operators import detect


@pytest.fixture
def model():
    """A loader of a model that fails on some texts; local functions travel to the workers by value."""
    def broken(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return [("toxic", 0.9)] * len(texts)

    return lambda: broken


def decided(spark, load, **options):
    rows = [(1, "plain words"), (2, "bad words"), (3, None), (4, "more plain words")]
    df = spark.createDataFrame(rows, "prompt_id bigint, prompt string").coalesce(1)
    scorer = detect.batch_scorer(load)
    scored = detect.score_prompts(df, scorers={n: scorer for n in detect.RAW_COLUMNS}, **options)
    return {r.prompt_id: r for r in scored.collect()}


def test_a_failing_text_scores_nothing(spark, model):
    rows = decided(spark, model)
    assert rows[1].toxic_score > 0 and rows[4].toxic_score > 0
    assert rows[2].toxic_score == rows[2].hate_score == 0.0 and not rows[2].error


def test_a_failing_text_falls_back_where_asked(spark, model):
    rows = decided(spark, model, on_failure="fallback")
    assert rows[2].error and rows[2].winning_mechanism == "error" and not rows[1].error
    with pytest.raises(ValueError):
        decided(spark, model, on_failure="stop")


def test_a_model_that_does_not_load(spark):
    def load():
        raise OSError("no file")

    assert all(r.error for r in decided(spark, load, on_failure="fallback").values())


def test_modes_take_scorers_and_failed_rows(spark, model):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, f"words {i}") for i in range(6)], "prompt_id bigint, prompt string")
    scorer = detect.batch_scorer(model)
    rows = detect.compare_modes(
        df, scorers={n: scorer for n in detect.RAW_COLUMNS}, failed=F.col("prompt_id") < 2).collect()
    assert len(rows) == 18 and sum(r.error for r in rows) == 6
