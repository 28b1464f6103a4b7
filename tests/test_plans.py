"""Plans stay native, bounded and free of cross joins."""

from pathlib import Path

import pytest

from plan_tools import ROOT, plan_of
from wardlight.plans.queries import REGISTRY
from wardlight.plans.oracle import oracle

NATIVE = ["detect", "mode_compare", "decision_log", "model_run_log", "latency_quantiles_5m", "running_totals",
          "stratified_split", "dedup_prompts", "exact_overlap", "chat_context", "pr_curve", "ngram_bias",
          "event_counters", "legacy_detect", "concurrency", "latency_p95_exact", "seeded_shuffle", "best_checkpoint", "near_overlap", "tfidf_weights"]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cross_join(spark, small, name):
    plan = plan_of(REGISTRY[name](spark, small))
    for node in ("Python", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, f"{node} in {name}"


@pytest.mark.parametrize("name", ["chat_context", "class_samples"])
def test_top_rows_per_group_are_cut_before_the_shuffle(spark, small, name):
    assert "WindowGroupLimit" in plan_of(REGISTRY[name](spark, small))


def test_detect_neither_joins_nor_aggregates(spark, small):
    plan = plan_of(REGISTRY["detect"](spark, small))
    assert "Join" not in plan and "Aggregate" not in plan and "ENSURE_REQUIREMENTS" not in plan


def test_scan_reads_only_needed_columns(spark, small):
    assert "ReadSchema: struct<event_type:string>" in plan_of(REGISTRY["prediction_counters"](spark, small))


def test_sources_keep_to_the_rules():
    for path in [*Path(ROOT, "wardlight").rglob("*.py"), Path(ROOT, "__spark_entry__.py"), Path(ROOT, "bench.py")]:
        text = path.read_text()
        assert "localCheckpoint" not in text and "crossJoin" not in text, path


def test_every_query_has_sql_or_a_reason():
    without = set(REGISTRY) - set(oracle())
    assert without == {"details_json", "chat_log_build", "baseline_train_eval", "batch_scoring"}
    assert not set(oracle()) - set(REGISTRY)


def test_texts_stay_out_of_the_shuffle_and_the_sort(spark, small):
    for line in plan_of(REGISTRY["seeded_shuffle"](spark, small)).splitlines():
        assert not (("Exchange" in line or "Sort " in line) and "prompt" in line), line
    plan = plan_of(REGISTRY["dedup_prompts"](spark, small))
    assert "HashAggregate" in plan and "SortAggregate" not in plan
