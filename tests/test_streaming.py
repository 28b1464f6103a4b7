"""Streams over several micro-batches give what the batch operators give."""

import pandas as pd
from pyspark.sql import functions as F

from wardlight.operators import detect, logs, monitoring
from wardlight.plans import inputs
from wardlight.plans.queries import REGISTRY
from wardlight.session import scratch_path
from wardlight.streaming import jobs


def in_batches(spark, df, parts=4):
    """A stream that reads one file per micro-batch."""
    path = scratch_path(spark, "source")
    df.repartition(parts).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def as_set(df):
    return set(map(tuple, df.collect()))


def test_context_over_batches(spark, small):
    turns = inputs.table(spark, small, "conversations")
    extra = spark.createDataFrame([(999, i, "user", f"t{i}") for i in range(500)], turns.schema)
    turns = turns.unionByName(extra)
    path = scratch_path(spark, "out")
    jobs.write_batches(jobs.context(in_batches(spark, turns)), path, scratch_path(spark, "state"), "update")
    got = jobs.latest_per_window(spark, path, ["conv_id", "slot"]).select("conv_id", "slot", "role", "content")
    batch = monitoring.chat_context(turns).where((F.col("slot") > 0) & (F.col("slot") <= 6))
    assert as_set(got) == as_set(batch.select("conv_id", "slot", "role", "content"))


def test_rates_over_batches(spark, small):
    events = inputs.model_events(spark, small)
    path = scratch_path(spark, "out")
    stream = jobs.rates(in_batches(spark, events), watermark="100 days")
    jobs.write_batches(stream, path, scratch_path(spark, "state"), "update")
    got = jobs.latest_per_window(spark, path, ["window_start", "model_name"])
    assert got.agg(F.sum("n")).first()[0] == 5 * events.count()
    batch = monitoring.average_latency_sliding(events)
    assert as_set(got.select("window_start", "model_name")) == as_set(batch.select("window_start", "model_name"))


def test_dedup_over_batches(spark):
    rows = spark.createDataFrame(pd.DataFrame({"prompt": [f"p{i % 7}" for i in range(200)]}))
    rows = rows.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    path = scratch_path(spark, "out")
    jobs.write_batches(jobs.dedup(in_batches(spark, rows)).select("prompt"), path, scratch_path(spark, "state"))
    assert sorted(r["prompt"] for r in spark.read.parquet(path).collect()) == [f"p{i}" for i in range(7)]


def test_log_sinks_are_idempotent(spark, small):
    docs = inputs.table(spark, small, "documents")
    path = scratch_path(spark, "logs")
    build = {"decisions": lambda df: logs.decision_log(df, F.col("latency_s") * 1000.0)}
    source = in_batches(spark, docs, 2)
    for _ in range(2):  # the second run starts from nothing and writes the same batches again
        jobs.log_batches(detect.score_prompts(inputs.prompts_from(source)), build, path, scratch_path(spark, "state"))
    assert spark.read.parquet(f"{path}/decisions").count() == docs.count()


def test_a_failing_log_stops_nothing_and_a_retry_does_not_score_again(spark, small):
    docs = inputs.table(spark, small, "documents")
    path, source = scratch_path(spark, "logs"), in_batches(spark, docs, 2)

    def broken(df):
        raise RuntimeError("no log today")

    builders = {"broken": broken, "decisions": lambda df: logs.decision_log(df, F.col("latency_s") * 1000.0)}
    jobs.log_batches(detect.score_prompts(inputs.prompts_from(source)), builders, path, scratch_path(spark, "state"))
    assert spark.read.parquet(f"{path}/decisions").count() == docs.count()
    failures = spark.read.parquet(f"{path}/failures").collect()
    assert {(r.log, r.error) for r in failures} == {("broken", "RuntimeError: no log today")}
    before = sorted(spark.read.parquet(f"{path}/scored").inputFiles())
    del builders["broken"]
    jobs.log_batches(detect.score_prompts(inputs.prompts_from(source)), builders, path, scratch_path(spark, "state"))
    assert sorted(spark.read.parquet(f"{path}/scored").inputFiles()) == before
    assert spark.read.parquet(f"{path}/decisions").count() == docs.count()


def test_table_stream_reads_files_and_folders(spark, small):
    folder = scratch_path(spark, "tables")
    turns = inputs.table(spark, small, "conversations")
    turns.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    spark.range(5).write.parquet(f"{folder}/conversations.parquet.old")
    for source in (small, folder):
        path = scratch_path(spark, "out")
        jobs.write_batches(jobs.table_stream(spark, source, "conversations"), path, scratch_path(spark, "state"))
        assert as_set(spark.read.parquet(path).select(*turns.columns)) == as_set(turns)


def test_stream_queries_over_tables_of_several_files(spark, small):
    folder = scratch_path(spark, "tables")
    for name in ("conversations", "documents", "events"):
        inputs.table(spark, small, name).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    for name in ("stream_context", "stream_dedup", "stream_detect", "stream_logs", "stream_rates", "stream_histogram"):
        assert as_set(REGISTRY[name](spark, folder)) == as_set(REGISTRY[name](spark, small)), name
