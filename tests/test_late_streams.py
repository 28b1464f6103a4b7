"""Streams in slices: what the watermark drops, what expires, and what a restart keeps."""

import datetime

import pytest
from pyspark.sql import functions as F

from wardlight.operators import monitoring
from wardlight.plans import inputs, queries
from wardlight.session import scratch_path
from wardlight.streaming import jobs, late

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def test_late_rows_within_the_watermark_count_and_others_do_not(spark):
    rows = [(0, 0, 1.0), (0, 100, 1.0), (1, 95, 2.0), (1, 40, 4.0), (2, 100, 8.0)]  # slice 1 may reach back to minute 90
    df = spark.createDataFrame([(s, at(m), "m", v) for s, m, v in rows], "arrival int, ts timestamp, model_name string, latency_s double")
    path = scratch_path(spark, "late")
    late.replay([df], 3, lambda s: jobs.rates(s, minutes=1, slide=1, watermark="10 minutes"), path, "update")
    got = {(r.window_start - datetime.datetime(2024, 1, 1)).total_seconds() / 60: (r.n, r.avg_latency_ms)
           for r in jobs.latest_per_window(spark, path, ["window_start", "model_name"]).withColumn(
               "window_start", F.col("window_start").cast("timestamp_ntz")).collect()}
    assert got == {0.0: (1, 1000.0), 95.0: (1, 2000.0), 100.0: (2, 4500.0)}


def test_some_rows_of_the_registered_stream_are_late(spark, small):
    events = inputs.late_events(spark, small)
    total = queries.REGISTRY["stream_rates_late"](spark, small).agg(F.sum("n")).first()[0]
    assert 4.5 * events.count() < total < 5 * events.count()


def test_conversations_expire_and_begin_again(spark):
    turns = [(1, 1, 0, 0), (1, 2, 5, 0), (2, 1, 6, 0), (3, 1, 200, 1), (1, 3, 205, 2), (3, 2, 210, 2), (2, 2, 20, 2)]
    df = spark.createDataFrame([(c, t, "User" if t % 2 else "Bot", f"{c}.{t}", at(m), s) for c, t, m, s in turns],
                               "conv_id bigint, turn bigint, role string, text string, ts timestamp, arrival int")
    path = scratch_path(spark, "expiring")
    with late.rocksdb(spark):
        late.replay([df], 3, late.expiring_context, path, "update")
    got = sorted(tuple(r) for r in late.open_contexts(spark.read.parquet(path)).collect())
    # turn 2.2 comes after the watermark (minute 190) and is dropped
    assert got == [
        (1, 0, "expired", None, 2), (1, 6, "user", "1.3", 1), (2, 0, "expired", None, 1),
        (3, 5, "user", "3.1", 2), (3, 6, "assistant", "3.2", 2)]


def test_contexts_that_never_pause_equal_the_batch_form(spark, small):
    turns = inputs.paused_turns(spark, small).withColumn("ts", F.lit(START))
    path = scratch_path(spark, "expiring")
    with late.rocksdb(spark):
        late.replay([turns], inputs.SLICES, late.expiring_context, path, "update")
    got = late.open_contexts(spark.read.parquet(path)).select("conv_id", "slot", "role", "content")
    batch = monitoring.chat_context(inputs.table(spark, small, "conversations")).where((F.col("slot") > 0) & (F.col("slot") <= 6))
    assert set(map(tuple, got.collect())) == set(map(tuple, batch.select("conv_id", "slot", "role", "content").collect()))


def test_unmatched_prompts_appear_after_the_bound(spark):
    prompts = spark.createDataFrame([(1, at(0), 0), (2, at(1), 0), (3, at(2), 0), (9, at(500), 1)], "prompt_id bigint, ts timestamp, arrival int")
    outputs = spark.createDataFrame(
        [(1, at(4), "a", 0.1, 0), (2, at(12), "late", 0.2, 0), (9, at(500), "end", 0.9, 1)],
        "prompt_id bigint, output_ts timestamp, label string, score double, arrival int")
    path = scratch_path(spark, "outputs")
    late.replay([prompts.where("arrival = 0"), outputs.where("arrival = 0")], 1, late.joined_outputs, path)
    assert [r.prompt_id for r in spark.read.parquet(path).collect()] == [1]  # 2 and 3 may still get one
    path = scratch_path(spark, "outputs")
    late.replay([prompts, outputs], 2, late.joined_outputs, path)
    assert sorted((r.prompt_id, r.label) for r in spark.read.parquet(path).collect() if r.prompt_id != 9) == [(1, "a"), (2, None), (3, None)]


@pytest.mark.parametrize("name", ["stream_dedup_late", "stream_join_outputs"])
def test_replayed_rows_come_once(spark, small, name):
    found = queries.REGISTRY[name](spark, small)
    assert found.count() == found.select("prompt_id").distinct().count()
