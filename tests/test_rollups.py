"""Stored daily states against a scan of the log."""

import datetime

import pytest
from pyspark.sql import functions as F

from wardlight.operators import monitoring, rollups
from wardlight.plans import inputs, queries
from wardlight.session import scratch_path

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("as_of", ["2024-01-31 00:00:00", "2024-01-20 13:45:10"])
def test_states_equal_a_scan_and_sketches_are_near(spark, as_of):
    log, rollup = inputs.chat_events(spark, FOLDER), queries.chat_rollup()
    states = spark.read.parquet(rollups.update(rollup.states(log), scratch_path(spark, "states")))
    got = rollup.trailing(states, log, as_of, 7).select(
        "*", rollups.distinct_count("sessions").alias("sessions"), rollups.quantile("latency", 0.95).alias("p95"),
        rollups.mean("latency").alias("mean")).first()
    want = monitoring.chat_statistics(log, as_of).first()
    assert (got.n, got.flagged_count, round(got["mean"], 6)) == (want.total_chats, want.adversarial_detected, want.avg_latency)
    assert abs(got.sessions - want.unique_sessions_count) <= 0.03 * want.unique_sessions_count + 1
    recent = monitoring.since(log, as_of, 7).select("latency_seconds").toPandas()["latency_seconds"]
    assert abs((recent <= got.p95).mean() - 0.95) < 0.02 and got.latency_max == recent.max()


def test_a_repeated_update_changes_nothing(spark):
    def at(day, hour):
        return datetime.datetime(2024, 1, day, hour, tzinfo=datetime.timezone.utc)

    rollup = rollups.Rollup(by=["m"], measures={"v": F.col("v")}, distinct={"m": F.col("m")})
    log = spark.createDataFrame([("a", at(1, 3), 1.0), ("a", at(2, 4), 2.0), (None, at(2, 5), None), ("a", None, 9.0)], "m string, timestamp timestamp, v double")
    path = scratch_path(spark, "states")
    for rows in (log, log, log.where("day(timestamp) = 2")):
        rollups.update(rollup.states(rows), path)
    got = {r.m: (r.n, r.v_n, r.v_sum, r.v_max) for r in rollup.merged(spark.read.parquet(path)).collect()}
    assert got == {"a": (2, 2, 3.0, 2.0), None: (1, 0, None, None)}
    assert rollup.merged(rollup.states(log.limit(0))).count() == 0
