"""Reports over the run and decision logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYERS = ["high_confidence_trigger", "weak_signals_trigger", "majority_consensus", "weighted_ensemble"]


def _flagged() -> Column:
    return F.col("adversarial").cast("int")


def _percent() -> Column:
    return F.avg(_flagged()) * 100.0


def search_runs(log: DataFrame, where: Column | None = None, latest: int | None = None,
                ties: list[str] | None = None) -> DataFrame:
    """Filter, newest first, limit.  With a limit this is a top-k per partition, never a full sort."""
    found = log if where is None else log.where(where)
    if latest is None:
        return found
    return found.orderBy(F.col("ts").desc(), *(ties or ["prompt_id", "model_name"])).limit(latest)


def as_runs(log: DataFrame) -> DataFrame:
    """The run log as users search it: ``start_time``, and the fields of a run under params, metrics and tags."""
    kinds = {n: kind for n, kind in log.dtypes if n not in ("prompt_id", "prompt", "ts")}
    params = [n for n in kinds if n in ("model_name", "mode")]
    metrics = [n for n, kind in kinds.items() if kind in ("double", "float", "int", "bigint")]
    tags = [n for n, kind in kinds.items() if kind == "string" and n not in params]

    def group(names: list[str]) -> Column:
        return F.struct(*[F.col(n) for n in names])

    return log.select(
        "*", F.col("ts").alias("start_time"), group(params).alias("params"), group(metrics).alias("metrics"), group(tags).alias("tags"))


def search_runs_text(log: DataFrame, text: str = "", order_by: list[str] | None = None, latest: int | None = None) -> DataFrame:
    """Runs by the filter text and order that users write: ``params.model_name != 'x' AND metrics.score > 0.5``,
    ``tags.model_type = "individual"``, ``start_time DESC``.

    The text is a Spark SQL condition over ``as_runs``.  Its fields are columns of the log, so conditions reach the scan.
    """
    found = as_runs(log)
    found = found.where(text) if text.strip() else found
    if order_by:
        keys = [(part.split()[0], part.split()[1:2]) for part in order_by]
        found = found.orderBy(*[F.col(k).desc() if [d.upper() for d in how] == ["DESC"] else F.col(k).asc() for k, how in keys])
    found = found if latest is None else found.limit(latest)
    return found.drop("params", "metrics", "tags", "start_time")


def filter_runs(log: DataFrame, **equals: str) -> DataFrame:
    """Equality filters on any log column (model type, outcome, decision type, model)."""
    for name, value in equals.items():
        log = log.where(F.col(name) == value)
    return log


def model_run_summary(log: DataFrame, latest: int | None = None) -> DataFrame:
    runs = search_runs(log, F.col("inference_time_ms") > 0, latest)
    return runs.groupBy("model_name").agg(
        F.round(F.avg("score"), 3).alias("score_mean"),
        F.round(F.stddev_samp("score"), 3).alias("score_std"),
        F.count("score").alias("score_count"),
        F.round(F.avg("inference_time_ms"), 3).alias("time_mean"),
        F.round(F.max("inference_time_ms"), 3).alias("time_max"),
        F.round(F.min("inference_time_ms"), 3).alias("time_min"),
        F.sum(_flagged()).alias("adversarial_count"),
    )


def detection_rate(log: DataFrame, latest: int | None = None) -> DataFrame:
    runs = search_runs(log, F.col("inference_time_ms") > 0, latest)
    return runs.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("total"), F.sum(_flagged()).alias("adversarial"), F.round(_percent(), 6).alias("rate")
    )


def mechanism_stats(log: DataFrame, latest: int | None = None) -> DataFrame:
    """Triggers per vote layer and the share of them that ended adversarial; 0 where a layer never fired.

    The layers are counted side by side in one aggregate and turned into rows afterwards.
    """
    runs = search_runs(log, F.col("total_inference_time_ms") > 0, latest)
    counts = []
    for m in LAYERS:
        fired = F.coalesce(F.col(f"voting_{m}") == 1, F.lit(False))
        counts += [F.count_if(fired).alias(m), F.count_if(fired & F.col("adversarial")).alias(f"{m}_hits")]
    each = F.inline(F.array(*[
        F.struct(
            F.lit(m.replace("_", " ").title()).alias("mechanism"),
            F.col(m).alias("triggers"),
            F.round(
                F.when(F.col(m) > 0, F.col(f"{m}_hits") / F.col(m) * 100.0).otherwise(0.0), 6
            ).alias("accuracy"),
        )
        for m in LAYERS
    ]))
    return runs.agg(*counts).select(each)


def early_exit_stats(log: DataFrame, latest: int | None = None) -> DataFrame:
    runs = search_runs(log, F.col("total_inference_time_ms") > 0, latest)
    early = F.col("early_exit") == 1
    return runs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(early).alias("early_exits"),
        F.round(F.coalesce(F.avg(F.col("early_exit")) * 100.0, F.lit(0.0)), 6).alias("early_exit_rate"),
        F.round(F.avg(F.when(early, F.col("total_inference_time_ms"))), 6).alias("avg_early_time_ms"),
    )


def mode_stats(log: DataFrame, latest: int | None = None) -> DataFrame:
    runs = search_runs(log, F.col("total_inference_time_ms") > 0, latest)
    return runs.groupBy("sensitivity_mode").agg(
        F.count(F.lit(1)).alias("runs"),
        F.round(F.avg("total_inference_time_ms"), 6).alias("avg_time_ms"),
        F.round(_percent(), 6).alias("flagged_percent"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts per value, most frequent first; missing values are left out."""
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.col("n").desc(), column)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.agg(F.sum("n").alias("n")).scalar()
    return counted.select(column, "n", (F.col("n") / whole).alias("share"))


def recent_decisions(log: DataFrame, latest: int = 10, reason_chars: int = 23, prompt_chars: int = 28) -> DataFrame:
    """Newest decisions as report lines; missing fields get their default texts."""
    return search_runs(log, None, latest, ["prompt_id"]).select(
        "prompt_id",
        F.coalesce("timestamp", F.lit("Unknown")).alias("timestamp"),
        F.when(F.col("adversarial"), "ADVERSARIAL").otherwise("SAFE").alias("result"),
        F.substring(F.coalesce("decision_reason", F.lit("Unknown")), 1, reason_chars).alias("reason"),
        F.coalesce("total_inference_time_ms", F.lit(0.0)).alias("time_ms"),
        F.concat(F.substring(F.coalesce("prompt", F.lit("No prompt logged")), 1, prompt_chars), F.lit("...")).alias("prompt_preview"),
    )


def recent_runs(log: DataFrame, latest: int = 10) -> DataFrame:
    return search_runs(log, None, latest).select(
        "prompt_id",
        F.coalesce("run_name", F.lit("Unknown")).alias("run_name"),
        F.coalesce("model_name", F.lit("Unknown")).alias("model_name"),
        F.when(F.col("adversarial"), "ADVERSARIAL").otherwise("SAFE").alias("decision"),
        "score",
        "inference_time_ms",
        F.col("timestamp").alias("started"),
    )


def class_overview(log: DataFrame, latest: int | None = None) -> DataFrame:
    """Rows, share and mean length per class.  The total is summed over the two grouped rows, so the log is read once."""
    grouped = search_runs(log, None, latest, ["prompt_id"]).groupBy("detection_outcome").agg(
        F.count(F.lit(1)).alias("n"), F.avg("input_length").alias("_length")
    )
    whole = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return grouped.select(
        "detection_outcome",
        "n",
        F.round(F.col("n") / whole * 100.0, 6).alias("percent"),
        F.round("_length", 6).alias("avg_length"),
    )


def class_samples(log: DataFrame, latest: int | None = None, samples: int = 3, prompt_chars: int = 80) -> DataFrame:
    """Newest samples per class.  The rank filter is applied per map task first, so classes stay small."""
    newest = Window.partitionBy("detection_outcome").orderBy(F.col("ts").desc(), "prompt_id")
    ranked = search_runs(log, None, latest, ["prompt_id"]).withColumn("sample", F.row_number().over(newest))
    return ranked.where(F.col("sample") <= samples).select(
        "detection_outcome",
        F.col("sample").cast("bigint").alias("sample"),
        "prompt_id",
        F.concat(F.substring(F.coalesce("prompt", F.lit("No prompt")), 1, prompt_chars), F.lit("...")).alias("prompt"),
    )


def length_bucket(length: Column) -> Column:
    return (
        F.when(length < 50, "Short (<50 chars)")
        .when(length < 200, "Medium (50-200 chars)")
        .otherwise("Long (>200 chars)")
    )


def length_buckets(log: DataFrame, latest: int | None = None, more_than: int = 0) -> DataFrame:
    """Flag rate per length bucket; nothing at all unless there are more than ``more_than`` rows."""
    runs = search_runs(log, None, latest, ["prompt_id"])
    buckets = runs.groupBy(length_bucket(F.col("input_length")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.round(_percent(), 6).alias("flagged_percent")
    )
    whole = buckets.agg(F.sum("n").alias("n")).scalar()
    return buckets.where(whole > more_than)
