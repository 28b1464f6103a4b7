"""Monitoring aggregates over chat and inference logs: statistics, counters, histograms, rates, gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight import fixed_values as V
from wardlight.functions.text import constant
from wardlight.operators.ordered import running

BOUNDS = V.LATENCY_BUCKETS
QUANTILES = [0.5, 0.75, 0.9, 0.95, 0.99]
CONTEXT_TURNS = 6
MODEL_ALIASES = {"electra": "electra_small"}


def since(df: DataFrame, as_of: str, days: int, column: str = "timestamp") -> DataFrame:
    """Trailing time filter; ``as_of`` is a parameter so that a rerun gives the same rows."""
    start = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.where(F.col(column) >= start)


def chat_statistics(chats: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Totals of the last days; no row for an empty log.  A missing session counts as one session."""
    total, flagged = F.col("total_chats"), F.col("adversarial_detected")
    return (
        since(chats, as_of, days)
        .agg(
            F.count(F.lit(1)).alias("total_chats"),
            F.coalesce(F.sum(F.col("detection_results.is_adversarial").cast("int")), F.lit(0)).alias("adversarial_detected"),
            F.round(F.avg("latency_seconds"), 6).alias("avg_latency"),
            F.countDistinct("session_id").alias("_sessions"),
            F.coalesce(F.max(F.col("session_id").isNull().cast("int")), F.lit(0)).alias("_missing"),
        )
        .where(total > 0)
        .select(
            "total_chats",
            "adversarial_detected",
            (flagged / total).alias("adversarial_rate"),
            "avg_latency",
            (F.col("_sessions") + F.col("_missing")).alias("unique_sessions_count"),
        )
    )


def model_performance(perf: DataFrame, as_of: str, days: int = 7, model_name: str | None = None) -> DataFrame:
    recent = since(perf, as_of, days)
    if model_name is not None:
        recent = recent.where(F.col("model_name") == MODEL_ALIASES.get(model_name, model_name))
    return recent.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("total_inferences"),
        F.round(F.avg("inference_time_seconds"), 6).alias("avg_inference_time"),
        F.round(F.avg("adversarial_score"), 6).alias("avg_score"),
        F.max("adversarial_score").alias("max_score"),
        F.min("adversarial_score").alias("min_score"),
    )


def statistics(chats: DataFrame, perf: DataFrame, as_of: str, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Chat totals and model performance of the last days."""
    return chat_statistics(chats, as_of, days), model_performance(perf, as_of, days)


def statistics_rows(chat_totals: DataFrame, models: DataFrame) -> DataFrame:
    """The two statistics tables in one long form."""
    def long(df: DataFrame, part: str, name: Column, metrics: list[str]) -> DataFrame:
        cells = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics]
        return df.select(F.lit(part).alias("part"), name.alias("name"), F.inline(F.array(*cells)))

    chat = long(chat_totals, "chat", F.lit("all"), chat_totals.columns)
    return chat.unionByName(long(models, "model", F.col("model_name"), [c for c in models.columns if c != "model_name"]))


def event_counters(scored: DataFrame) -> DataFrame:
    """All labelled counters of a scored prompt log: (metric, model_name, kind) and a count.

    The label sets are fixed, so all counters are side-by-side conditional counts of one aggregate; the single result
    row is turned into rows afterwards.  Counters that never fired are left out.
    """
    flagged, failed, every = F.col("is_adversarial"), F.col("error"), F.lit(True)
    counters = [
        ("chat_requests_total", None, None, every),
        ("adversarial_detections_total", "fast_ensemble", None, flagged & ~failed),
        ("adversarial_detections_total", "fallback_detector", None, flagged & failed),
        ("safe_prompts_total", None, None, ~flagged),
        ("model_inference_errors_total", "fast_detector", "detection_failure", failed),
    ]
    for model, short in zip(V.COUNTER_MODELS, V.SCORE_NAMES):
        counters.append(("model_inference_total", model, "fast_detector", every))
        counters.append(("adversarial_detections_total", model, None, F.col(f"{short}_score") > V.MODEL_THRESHOLD))
    counted = scored.agg(*[F.count_if(when).alias(f"c{i}") for i, (*_, when) in enumerate(counters)])
    rows = F.inline(F.array(*[
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit(model).cast("string").alias("model_name"),
            F.lit(kind).cast("string").alias("kind"),
            F.col(f"c{i}").alias("n"),
        )
        for i, (metric, model, kind, _) in enumerate(counters)
    ]))
    return counted.select(rows).where(F.col("n") > 0)


def failure_counters(chats: DataFrame) -> DataFrame:
    """Failed chat requests per error type (column ``error_type``, NULL for chats that went through)."""
    failed = chats.where(F.col("error_type").isNotNull())
    return failed.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))


def prediction_counters(events: DataFrame) -> DataFrame:
    return events.groupBy("model_name").agg(F.count(F.lit(1)).alias("n"))


def _bucket_counts(latency: Column) -> list[Column]:
    """Cumulative counters, one per bucket bound; they combine on the map side."""
    bounds = [F.lit(b) if b != float("inf") else F.lit("Infinity").cast("double") for b in BOUNDS]
    return [F.count_if(latency <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]


def _cumulative() -> Column:
    return F.array(*[F.col(f"le_{i}") for i in range(len(BOUNDS))])


def latency_histogram(events: DataFrame) -> DataFrame:
    """Cumulative bucket counts with sum and count per model."""
    grouped = events.groupBy("model_name").agg(
        *_bucket_counts(F.col("latency_s")),
        F.round(F.sum("latency_s"), 6).alias("latency_sum"),
        F.count("latency_s").alias("latency_count"),
    )
    labels = F.array(*[F.lit("+Inf" if b == float("inf") else f"{b:g}") for b in BOUNDS])
    pairs = F.explode(F.arrays_zip(labels.alias("le"), _cumulative().alias("n")))
    return grouped.select("model_name", pairs.alias("b"), "latency_sum", "latency_count").select(
        "model_name", "b.le", F.col("b.n").alias("cumulative_count"), "latency_sum", "latency_count"
    )


def histogram_quantile(cumulative: Column, q: float) -> Column:
    """Linear interpolation in the first bucket that reaches the rank; the lower bound in the open bucket."""
    lows = constant([0.0, *BOUNDS[:-1]], "array<double>")
    highs = constant([*BOUNDS[:-1], BOUNDS[-2]], "array<double>")
    rank = F.get(cumulative, F.lit(len(BOUNDS) - 1)) * F.lit(q)
    at = (F.array_position(F.transform(cumulative, lambda n: n >= rank), True) - 1).cast("int")
    low, before = F.get(lows, at), F.coalesce(F.get(cumulative, at - 1), F.lit(0))
    inside = low + (F.get(highs, at) - low) * (rank - before) / (F.get(cumulative, at) - before)
    return F.when(at == len(BOUNDS) - 1, low).otherwise(inside)


def latency_quantile(events: DataFrame, q: float = 0.95) -> DataFrame:
    """Quantile of the whole histogram per model, in milliseconds."""
    grouped = events.groupBy("model_name").agg(*_bucket_counts(F.col("latency_s")))
    return grouped.select("model_name", F.round(histogram_quantile(_cumulative(), q) * 1000.0, 6).alias("latency_ms"))


def _sliding(per_minute: DataFrame, minutes: int) -> DataFrame:
    """Give each per-minute row to every window it belongs to; only pre-aggregated rows are multiplied."""
    starts = F.sequence(
        F.col("minute") - F.expr(f"INTERVAL {minutes - 1} MINUTES"), F.col("minute"), F.expr("INTERVAL 1 MINUTE")
    )
    return per_minute.withColumn("window_start", F.explode(starts))


def latency_quantiles_sliding(events: DataFrame, minutes: int = 5) -> DataFrame:
    per_minute = events.groupBy("model_name", F.date_trunc("minute", "ts").alias("minute")).agg(
        *_bucket_counts(F.col("latency_s"))
    )
    windows = _sliding(per_minute, minutes).groupBy("window_start", "model_name").agg(
        *[F.sum(f"le_{i}").alias(f"le_{i}") for i in range(len(BOUNDS))]
    )
    return windows.select("window_start", "model_name", _cumulative().alias("_cumulative")).select(
        "window_start",
        "model_name",
        *[F.round(histogram_quantile(F.col("_cumulative"), q) * 1000.0, 6).alias(f"p{round(q * 100)}_ms") for q in QUANTILES],
    )


def average_latency_sliding(events: DataFrame, minutes: int = 5) -> DataFrame:
    per_minute = events.groupBy("model_name", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.sum("latency_s").alias("s"), F.count("latency_s").alias("n")
    )
    return _sliding(per_minute, minutes).groupBy("window_start", "model_name").agg(
        F.round(F.sum("s") / F.sum("n") * 1000.0, 6).alias("avg_latency_ms")
    )


def request_rate(events: DataFrame, minutes: int = 1) -> DataFrame:
    """Requests per second and model in tumbling windows: count / window seconds (no extrapolation)."""
    window = F.window("ts", f"{minutes} minutes")
    return events.groupBy(window.alias("w"), "model_name").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), "model_name", (F.col("n") / F.lit(60.0 * minutes)).alias("rate")
    )


def running_totals(events: DataFrame) -> DataFrame:
    """Cumulative request count per model at every event."""
    slim = events.select("event_id", "ts", "model_name")
    return running(slim, [F.col("ts"), F.col("event_id")], {"total": F.lit(1).cast("bigint")}, ["model_name"])


def concurrency(events: DataFrame) -> DataFrame:
    """In-flight requests after every change: +1 at the start, -1 at the end, ends before starts."""
    start = F.unix_micros("ts")
    spent = F.round(F.col("latency_s") * 1_000_000.0).cast("bigint")
    changes = events.select(F.explode(F.array(
        F.struct(start.alias("t_us"), F.lit(1).alias("delta")),
        F.struct((start + spent).alias("t_us"), F.lit(-1).alias("delta")),
    )).alias("c")).groupBy("c.t_us", "c.delta").agg(F.sum("c.delta").alias("change"))
    placed = running(changes, [F.col("t_us"), F.col("delta")], {"in_flight": F.col("change")})
    return placed.select("t_us", "delta", "change", "in_flight")


def chat_context(turns: DataFrame, keep: int = CONTEXT_TURNS) -> DataFrame:
    """Model context per conversation: system line, the last turns in order, the latest user message again.

    The rank filter runs per map task before the shuffle, so a long conversation sends ``keep`` rows per task.
    """
    latest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    recent = turns.withColumn("_rank", F.row_number().over(latest)).where(F.col("_rank") <= keep).select(
        "conv_id",
        (F.lit(keep + 1) - F.col("_rank")).cast("bigint").alias("slot"),
        F.when(F.lower("role") == "user", "user").otherwise("assistant").alias("role"),
        F.col("text").alias("content"),
    )
    ends = turns.groupBy("conv_id").agg(
        F.max_by("text", F.when(F.lower("role") == "user", F.col("turn"))).alias("message"),
        F.max(F.when(F.lower("role") == "user", F.col("turn"))).alias("_asked"),
    )
    framed = ends.select("conv_id", F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("slot"), F.lit("system").alias("role"), F.lit(V.SYSTEM_LINE).alias("content")),
        F.struct(F.lit(keep + 1).cast("bigint").alias("slot"),
                 F.when(F.col("_asked").isNotNull(), "user").alias("role"), F.col("message").alias("content")),
    )).alias("m")).select("conv_id", "m.*").where(F.col("role").isNotNull())
    return recent.unionByName(framed)
