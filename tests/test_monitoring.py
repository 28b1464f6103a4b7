"""Statistics, histograms and contexts at their edges."""

import pytest
from pyspark.sql import functions as F

from wardlight.operators import monitoring
from wardlight.operators.monitoring import BOUNDS
from wardlight.plans import inputs

CHAT = ("timestamp timestamp, session_id string, latency_seconds double, "
        "detection_results struct<is_adversarial: boolean>")


def chats(spark, rows):
    df = spark.createDataFrame(rows, "ts string, session_id string, latency_seconds double, flag boolean")
    return df.select(F.col("ts").cast("timestamp").alias("timestamp"), "session_id", "latency_seconds",
                     F.struct(F.col("flag").alias("is_adversarial")).alias("detection_results"))


def test_chat_statistics(spark):
    rows = [("2024-01-20 00:00:00", "a", 1.0, True), ("2024-01-20 00:00:00", "a", 3.0, False),
            ("2024-01-24 00:00:00", None, 2.0, False), ("2024-01-01 00:00:00", "z", 9.0, True)]
    row = monitoring.chat_statistics(chats(spark, rows), "2024-01-25 00:00:00").first()
    assert tuple(row) == (3, 1, 1 / 3, 2.0, 2)
    assert monitoring.chat_statistics(chats(spark, rows), "2025-01-25 00:00:00").count() == 0


def test_histogram_is_cumulative_and_complete(spark, small):
    rows = monitoring.latency_histogram(inputs.model_events(spark, small)).collect()
    for model in {r["model_name"] for r in rows}:
        counts = {r["le"]: r["cumulative_count"] for r in rows if r["model_name"] == model}
        ordered = [counts["+Inf" if b == float("inf") else f"{b:g}"] for b in BOUNDS]
        assert ordered == sorted(ordered) and ordered[-1] == next(r["latency_count"] for r in rows if r["model_name"] == model)


@pytest.mark.parametrize("latencies, q, expected", [
    ([0.05] * 4, 0.5, 0.0375), ([20.0, 30.0], 0.95, 10.0), ([0.001], 0.5, 0.0025), ([0.001, 20.0], 0.5, 0.005),
])
def test_histogram_quantile(spark, latencies, q, expected):
    df = spark.createDataFrame([("m", x) for x in latencies], "model_name string, latency_s double")
    assert monitoring.latency_quantile(df, q).first()["latency_ms"] == pytest.approx(expected * 1000)


def test_concurrency_ends_at_zero_and_counts_ends_first(spark):
    df = spark.createDataFrame([(0, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:01", 1.0)],
                               "event_id int, ts string, latency_s double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = monitoring.concurrency(df).orderBy("t_us", "delta").collect()
    assert [r["in_flight"] for r in rows] == [1, 0, 1, 0]


def test_context_of_a_long_and_a_silent_conversation(spark):
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(11)] + [(2, 0, "system", "hi")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    rows = monitoring.chat_context(df).orderBy("conv_id", "slot").collect()
    first = [(r["slot"], r["role"], r["content"]) for r in rows if r["conv_id"] == 1]
    assert [c for _, _, c in first[1:7]] == [f"t{i}" for i in range(5, 11)] and first[7] == (7, "user", "t10")
    assert [(r["slot"], r["role"]) for r in rows if r["conv_id"] == 2] == [(0, "system"), (6, "assistant")]


def test_log_time_zone(spark):
    """The chat log keeps instants; its own zone is a matter of rendering."""
    row = spark.sql("SELECT from_utc_timestamp(timestamp'2024-01-01 08:00:00', 'US/Pacific') AS t").first()
    assert str(row["t"]) == "2024-01-01 00:00:00"
