"""Streams whose rows arrive late: replay in slices, expiring conversations, prompts joined with their late outputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardlight.operators.monitoring import CONTEXT_TURNS
from wardlight.session import scratch_path, stored
from wardlight.streaming.jobs import last_turns, write_batches

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EXPIRY_MINUTES = 60


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def replay(
    inputs: list[DataFrame], slices: int, build: Callable[..., DataFrame], path: str, mode: str = "append", arrival: str = "arrival",
) -> None:
    """Feed rows to a stream in the order of their ``arrival`` (0 .. slices - 1) and write every micro-batch to ``path``.

    ``build`` makes the result from one stream for each input.  After each slice the stream is stopped and started again
    from its checkpoint, so a slice is one batch, whatever its number of files, and the watermark that holds for it is
    that of all slices before.
    """
    spark = inputs[0].sparkSession
    known = [stored(df, "arrivals") for df in inputs]
    folders = [scratch_path(spark, "slices") for _ in inputs]
    checkpoint = scratch_path(spark, "state")
    for number in range(slices):
        for df, folder in zip(known, folders):
            df.where(F.col(arrival) == number).drop(arrival).write.parquet(f"{folder}/slice-{number}")
        streams = [spark.readStream.schema(df.drop(arrival).schema).parquet(f"{folder}/*") for df, folder in zip(known, folders)]
        write_batches(build(*streams), path, checkpoint, mode)


class Conversation(StatefulProcessor):
    """The last turns of one conversation, forgotten a time after its last turn."""

    def __init__(self, keep: int, expiry_ms: int):
        self.keep, self.expiry_ms = keep, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn bigint, role string, text string")
        self.session = handle.getValueState("session", "n bigint, last_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(t), r, x) for t, r, x in self.turns.get()]
        n, last = self.session.get() if self.session.exists() else (0, 0)
        before = last
        for batch in rows:
            n += len(batch)
            last = max(last, int(batch["ts"].max().value // 1_000_000))
            held += list(zip(batch["turn"].tolist(), batch["role"].tolist(), batch["text"].tolist()))
            held = sorted(held, key=lambda t: t[0])[-self.keep:]
        self.turns.put(held)
        self.session.update((n, last))
        if before:
            self.handle.deleteTimer(before + self.expiry_ms)
        self.handle.registerTimer(last + self.expiry_ms)
        yield pd.DataFrame({
            "conv_id": [key[0]] * len(held), "slot": [self.keep - len(held) + 1 + i for i in range(len(held))],
            "role": ["user" if str(role).lower() == "user" else "assistant" for _, role, _ in held],
            "content": [text for _, _, text in held], "n_turns": [n] * len(held)})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _ = self.session.get()
        self.turns.clear()
        self.session.clear()
        yield pd.DataFrame({"conv_id": [key[0]], "slot": [0], "role": ["expired"], "content": [None], "n_turns": [n]})

    def close(self) -> None:
        pass


def expiring_context(turns: DataFrame, keep: int = CONTEXT_TURNS, minutes: int = EXPIRY_MINUTES, watermark: str = "10 minutes") -> DataFrame:
    """conv_id, slot, role, content, n_turns: the last turns of every conversation that a batch changes, and one row in
    slot 0 with the role ``expired`` for each conversation that had no turn for ``minutes`` of event time.

    A turn after that begins a new conversation under the same id.  The state of a conversation is its last turns and a
    timer, so it leaves with the conversation.  The query needs the RocksDB state store (see ``rocksdb``).
    """
    slim = turns.select("conv_id", "turn", "role", "text", "ts").withWatermark("ts", watermark)
    return slim.groupBy("conv_id").transformWithStateInPandas(
        Conversation(keep, minutes * 60_000), "conv_id bigint, slot bigint, role string, content string, n_turns bigint", "update", "EventTime")


def open_contexts(batches: DataFrame) -> DataFrame:
    """The newest state of every conversation in the batches of ``expiring_context``, and all expired ones."""
    newest = batches.groupBy("conv_id").agg(
        F.max(F.struct("batch", (F.col("role") == "expired").alias("gone"))).alias("newest"))
    kept = batches.join(newest, "conv_id").where(
        (F.col("role") == "expired") | ((F.col("batch") == F.col("newest.batch")) & ~F.col("newest.gone")))
    return kept.select("conv_id", "slot", "role", "content", "n_turns")


def joined_outputs(prompts: DataFrame, outputs: DataFrame, minutes: int = 10, watermark: str = "10 minutes") -> DataFrame:
    """Every prompt (prompt_id, ts) with the output (prompt_id, output_ts, label, score) that came within ``minutes``.

    A prompt without one appears with nulls as soon as the watermark shows that none can come; both sides leave the state
    by then.
    """
    left = prompts.withWatermark("ts", watermark).alias("p")
    right = outputs.withColumnRenamed("prompt_id", "output_id").withWatermark("output_ts", watermark).alias("o")
    same = F.expr(f"prompt_id = output_id AND output_ts >= ts AND output_ts <= ts + INTERVAL {int(minutes)} MINUTES")
    return left.join(right, same, "left_outer").select("prompt_id", "ts", "output_ts", "label", "score")
