"""Structured Streaming forms: scoring, rates, chat context, deduplication and log sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardlight.operators.monitoring import BOUNDS, CONTEXT_TURNS, _bucket_counts

WATERMARK = "10 minutes"
FAILURE_CHARS = 2_000


def table_stream(spark: SparkSession, folder: str, name: str, parts: int | None = None) -> DataFrame:
    """Stream over one table of a folder, a file or a folder of files; ``parts`` spreads the rows of every batch for
    heavy work.

    The pattern matches the table's own name only: a file stream refuses a plain path that is a single file.
    """
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{folder}/{name}.parque[t]")
    return stream.repartition(parts) if parts else stream


def run_available(writer, checkpoint: str) -> StreamingQuery:
    """Process what is there and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write every micro-batch to its own folder: a repeated batch overwrites itself."""
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return run_available(stream.writeStream.outputMode(mode).foreachBatch(save), checkpoint)


def log_batches(scored: DataFrame, builders: dict[str, Callable[[DataFrame], DataFrame]], path: str,
                checkpoint: str) -> StreamingQuery:
    """Write several logs of one scored stream.

    The scored rows of a batch are written once and every log is built from that table: a repeated batch finds them
    complete and does not score again.  A log that fails stops neither the others nor the stream; its error is written
    to ``failures`` and its batch can be built later from the scored rows.  Folders are keyed by batch id, so a retry
    replaces and never doubles.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        base, mark = f"{path}/scored/batch={batch_id}", f"{path}/complete/batch={batch_id}"
        if not _exists(spark, mark):
            batch.write.mode("overwrite").parquet(base)
            spark.range(1).write.mode("overwrite").parquet(mark)
        stored = spark.read.schema(batch.schema).parquet(base)
        failed = []
        for name, build in builders.items():
            try:
                build(stored).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
            except Exception as failure:  # a log is never a reason to stop scoring
                failed.append((batch_id, name, f"{type(failure).__name__}: {failure}"[:FAILURE_CHARS]))
        if failed:
            rows = spark.createDataFrame(failed, "batch_id bigint, log string, error string")
            rows.write.mode("overwrite").parquet(f"{path}/failures/batch={batch_id}")

    return run_available(scored.writeStream.foreachBatch(save), checkpoint)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True


def rates(events: DataFrame, minutes: int = 5, slide: int = 1, watermark: str = WATERMARK) -> DataFrame:
    """Request rate and mean latency per model in sliding event-time windows."""
    window = F.window("ts", f"{minutes} minutes", f"{slide} minutes")
    return events.withWatermark("ts", watermark).groupBy(window.alias("w"), "model_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("latency_s").alias("s")
    ).select(
        F.col("w.start").alias("window_start"),
        "model_name",
        "n",
        (F.col("n") / F.lit(60.0 * minutes)).alias("rate"),
        F.round(F.col("s") / F.col("n") * 1000.0, 6).alias("avg_latency_ms"),
    )


def histogram(events: DataFrame, minutes: int = 5, slide: int = 1, watermark: str = WATERMARK) -> DataFrame:
    """Cumulative latency buckets per model and sliding window; readers interpolate quantiles from them."""
    window = F.window("ts", f"{minutes} minutes", f"{slide} minutes")
    counted = events.withWatermark("ts", watermark).groupBy(window.alias("w"), "model_name").agg(
        *_bucket_counts(F.col("latency_s"))
    )
    return counted.select(F.col("w.start").alias("window_start"), "model_name", *[f"le_{i}" for i in range(len(BOUNDS))])


def latest_per_window(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Final state of an update-mode stream: the row of the last batch per key."""
    stored = spark.read.parquet(path)
    values = [c for c in stored.columns if c not in (*keys, "batch")]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")


def dedup(stream: DataFrame, text: str = "prompt", ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """First arrival of every prompt within the watermark; the state holds digests, not texts."""
    return stream.withColumn("digest", F.sha2(F.col(text), 256)).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(
        ["digest"]
    )


def last_turns(turns: pd.DataFrame, keep: int) -> pd.DataFrame:
    return turns.sort_values("turn").groupby("conv_id", sort=False).tail(keep)


def context(turns: DataFrame, keep: int = CONTEXT_TURNS, hours: float | None = None) -> DataFrame:
    """Last turns per conversation as running state.

    With ``hours`` a conversation is forgotten after that time without a new turn.  Such a stream never runs out of
    work, so it is for continuous triggers; without, state stays, as a run over what is there needs it to.

    Each Arrow batch is first cut to the last turns it holds per conversation.  That loses nothing, and keeps a very
    long conversation from sending all its turns to the one task that owns its state.
    """
    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield last_turns(batch, keep)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [tuple(t) for t in state.get[0]] if state.exists else []
        for batch in batches:
            held += list(zip(batch["turn"].tolist(), batch["role"].tolist(), batch["text"].tolist()))
            held = sorted(held)[-keep:]
        state.update((held,))
        if hours is not None:
            state.setTimeoutDuration(int(hours * 3_600_000))
        yield pd.DataFrame({
            "conv_id": [key[0]] * len(held),
            "slot": [keep - len(held) + 1 + i for i in range(len(held))],
            "role": ["user" if str(role).lower() == "user" else "assistant" for _, role, _ in held],
            "content": [text for _, _, text in held],
        })

    slim = turns.select("conv_id", "turn", "role", "text")
    return slim.mapInPandas(shrink, slim.schema).groupBy("conv_id").applyInPandasWithState(
        update,
        "conv_id bigint, slot bigint, role string, content string",
        "turns array<struct<turn: bigint, role: string, text: string>>",
        "update",
        GroupStateTimeout.NoTimeout if hours is None else GroupStateTimeout.ProcessingTimeTimeout,
    )
