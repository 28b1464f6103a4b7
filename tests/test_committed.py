"""Committed logs and searches by filter text."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plan_tools import plan_of
from wardlight.operators import reports
from wardlight.plans import queries
from wardlight.session import scratch_path, stored
from wardlight.sources import tabular
from wardlight.sources.committed import CommittedLog

SCHEMA = "id bigint, extra map<string, string>"


def log_of(spark):
    return CommittedLog(spark, scratch_path(spark, "log"), SCHEMA)


def rows(spark, *ids):
    return spark.createDataFrame([(i, {"a": "b"}) for i in ids], SCHEMA)


def ids(log):
    return sorted(r.id for r in log.read().collect())


def test_a_repeated_append_changes_nothing(spark):
    log = log_of(spark)
    assert ids(log) == [] and log.merge() == 0
    assert log.append(rows(spark, 1, 2), "x/1") and not log.append(rows(spark, 1, 2), "x/1")
    assert log.append(rows(spark, 2, 3), "x/2") and ids(log) == [1, 2, 2, 3]
    assert log.merge() == 2 and ids(log) == [1, 2, 2, 3]
    assert not log.append(rows(spark, 1, 2), "x/1") and ids(log) == [1, 2, 2, 3]
    assert log.append(rows(spark, 4), "x/3") and log.merge() == 2 and ids(log) == [1, 2, 2, 3, 4]


def test_what_is_not_committed_is_not_read(spark):
    log = log_of(spark)
    log.append(rows(spark, 1), "a")
    rows(spark, 7).write.parquet(f"{log.path}/data/left-by-a-failed-writer")
    assert ids(log) == [1]


def test_two_writers_of_one_key_and_two_merges_at_once(spark):
    log = log_of(spark)
    for value in (1, 2):  # neither saw the other's commit
        folder = log._fresh("k")
        rows(spark, value).write.parquet(f"{log.path}/data/{folder}")
        log._commit("k", folder)
    once = ids(log)
    assert once in ([1], [2])
    log.append(rows(spark, 5), "b")
    log.append(rows(spark, 6), "c")
    folders, keys = log._live()
    for part in (folders, folders[:2]):  # two merges that began with the same folders
        folder = log._fresh("merge")
        spark.read.schema(SCHEMA).parquet(*[f"{log.path}/data/{f}" for f in part]).write.parquet(f"{log.path}/data/{folder}")
        log._commit(folder, folder, True, part, sorted(keys))
    assert ids(log) == sorted([*once, 5, 6])


def test_filter_text(spark, small):
    log = stored(queries.run_log(spark, small), "runs")
    found = reports.search_runs_text(log, "params.model_name != 'toxic' AND metrics.inference_time_ms > 0 AND metrics.score >= 0.5")
    want = log.where((F.col("model_name") != "toxic") & (F.col("inference_time_ms") > 0) & (F.col("score") >= 0.5))
    assert found.columns == log.columns and found.count() == want.count() > 0
    plan = plan_of(found.select("score"))
    assert "PushedFilters: [IsNotNull(model_name)" in plan and "struct(" not in plan.split("FileScan")[0]
    quoted = reports.search_runs_text(log, 'tags.model_type = "individual" AND tags.detection_outcome LIKE "adv%"', ["metrics.score DESC", "prompt_id"], 5)
    assert [r.score for r in quoted.collect()] == sorted((r.score for r in quoted.collect()), reverse=True)
    assert reports.search_runs_text(log).count() == log.count()
    with pytest.raises(AnalysisException):
        reports.search_runs_text(log, "params.no_such = 'x'").count()


def test_days_are_dealt_by_values(spark):
    df = spark.range(1000).select("id", F.lit("2024-01-01 00:00:00").cast("timestamp").alias("ts"), F.create_map(F.lit("a"), "id").alias("m"))
    path = tabular.append_log(df, scratch_path(spark, "days"), files_per_day=4)
    assert tabular.read_log(spark, path).count() == 1000
