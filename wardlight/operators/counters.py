"""Series of scraped counters: samples of running totals that start again from zero when a process restarts.

A sample says how much a counter had counted when it was read.  What happened between two samples is their difference,
unless the later one is lower: then the process restarted, and the later value itself is what was counted since.

The rows of one series may be any share of all.  They are range-partitioned by (series, time); every range keeps its
first value, its last value and what it lost at resets, and these borders are handed on to the ranges after it.  Windows
are then built from one first and one last sample for each series and step, not from the samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.operators.monitoring import histogram_quantile
from wardlight.session import stored

RANGE, GROUP = "_range", "_group"
SPACING = 1.1  # a window is extended to its border if the nearest sample is at most so many mean distances away


def _lost(value: Column, before: Column) -> Column:
    """What a reset took from a counter: the value before it."""
    return F.when(value < before, before).otherwise(F.lit(0.0))


def corrected(samples: DataFrame, by: list[str], values: list[str], ts: str = "ts") -> DataFrame:
    """``samples`` with, for every counter of ``values``, ``_total_`` + its name: its value plus all that resets took.

    A series has one sample for each time.  Samples without a time are left out; a missing value counts as the value
    before it, so that one counter can be missing where others of the same sample are there.
    """
    spread = samples.where(F.col(ts).isNotNull()).repartitionByRange(*[F.col(k) for k in by], F.col(ts))
    # borders are drawn from a sample of the rows: what lies in which range has to be settled before it is read twice
    ranged = stored(spread.withColumn(RANGE, F.spark_partition_id()), "ranged").withColumn(GROUP, F.struct(*by, RANGE))
    here = Window.partitionBy(GROUP).orderBy(ts)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = ranged.withColumns({f"_v_{v}": F.last(F.col(v).cast("double"), ignorenulls=True).over(upto) for v in values})
    lost = known.withColumns({f"_l_{v}": _lost(F.col(f"_v_{v}"), F.lag(f"_v_{v}").over(here)) for v in values})
    local = stored(lost.withColumns({f"_s_{v}": F.sum(f"_l_{v}").over(upto) for v in values}).drop(*[f"_l_{v}" for v in values]), "local")

    borders = local.groupBy(*by, RANGE).agg(
        *[f(f"_v_{v}", F.when(F.col(f"_v_{v}").isNotNull(), F.col(ts))).alias(f"_{n}_{v}")
          for v in values for n, f in (("first", F.min_by), ("last", F.max_by))],
        *[F.max(f"_s_{v}").alias(f"_in_{v}") for v in values])
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    handed = borders.withColumns({f"_before_{v}": F.last(f"_last_{v}", ignorenulls=True).over(earlier) for v in values})
    handed = handed.withColumns({f"_edge_{v}": _lost(F.col(f"_first_{v}"), F.col(f"_before_{v}")) for v in values})
    offsets = handed.select(
        F.struct(*by, RANGE).alias(GROUP), *[f"_before_{v}" for v in values],
        *[(F.sum(F.col(f"_edge_{v}") + F.col(f"_in_{v}")).over(through) - F.col(f"_in_{v}")).alias(f"_o_{v}") for v in values])
    return local.join(offsets, GROUP).select(
        *samples.columns,
        *[(F.coalesce(f"_v_{v}", f"_before_{v}") + F.col(f"_s_{v}") + F.col(f"_o_{v}")).alias(f"_total_{v}") for v in values])


def windows(
    samples: DataFrame, by: list[str], values: list[str], minutes: int = 5, step_s: int = 60, ts: str = "ts", totals: bool = True,
) -> DataFrame:
    """by, at, n, first and last (ts, and each counter as read and as ``_total_``) of the samples in (at - minutes, at].

    ``at`` runs over all multiples of ``step_s`` seconds whose window holds a sample.  ``minutes`` is a multiple of it.
    """
    if minutes * 60 % step_s:
        raise ValueError("the window must be a multiple of the step")
    rows = corrected(samples, by, values, ts) if totals else samples
    step = step_s * 1_000_000
    sample = F.struct(F.col(ts).alias("ts"), *[F.col(v).cast("double").alias(v) for v in values], *([f"_total_{v}" for v in values] if totals else []))
    place = F.ceil(F.unix_micros(ts) / F.lit(step)).cast("bigint")
    steps = rows.groupBy(*by, place.alias("_step")).agg(F.count(F.lit(1)).alias("n"), F.min(sample).alias("first"), F.max(sample).alias("last"))
    spread = steps.withColumn("_step", F.explode(F.sequence(F.col("_step"), F.col("_step") + (minutes * 60 // step_s - 1))))
    found = spread.groupBy(*by, "_step").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    return found.select(*by, F.timestamp_micros(F.col("_step") * step).alias("at"), "n", "first", "last")


def _seconds(late: Column, early: Column) -> Column:
    return (F.unix_micros(late) - F.unix_micros(early)).cast("double") / 1e6


def rate(value: str, minutes: int = 5) -> Column:
    """Increase per second of a counter over rows of ``windows``, extended from the first and last sample to the borders.

    A border is reached if its nearest sample is about as far away as samples are from each other, otherwise half such
    a distance is added.  At the start a counter is never extended to before it was zero.  Null with one sample only.
    """
    first, last = F.col("first"), F.col("last")
    increase = last[f"_total_{value}"] - first[f"_total_{value}"]
    span = _seconds(last["ts"], first["ts"])
    apart = span / (F.col("n") - 1)
    to_start = F.lit(minutes * 60.0) - _seconds(F.col("at"), first["ts"])
    to_end = _seconds(F.col("at"), last["ts"])
    to_start = F.when(to_start >= apart * SPACING, apart / 2).otherwise(to_start)
    to_zero = span * (first[value] / increase)
    to_start = F.when((increase > 0) & (first[value] >= 0) & (to_zero < to_start), to_zero).otherwise(to_start)
    to_end = F.when(to_end >= apart * SPACING, apart / 2).otherwise(to_end)
    return F.when(F.col("n") > 1, increase * ((span + to_start + to_end) / span) / F.lit(minutes * 60.0))


def never_falling(values: Column) -> Column:
    """Cumulative buckets of which each is at least as high as all before it."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda done, v: F.concat(
        done, F.array(F.greatest(v, F.try_element_at(done, F.lit(-1))))))


def bucket_quantiles(windows: DataFrame, buckets: list[Column], quantiles: list[float], by: list[str]) -> DataFrame:
    """by, at and quantiles in milliseconds of cumulative buckets; null where nothing was counted."""
    # a column of its own: every quantile refers to it many times
    level = windows.select("at", *by, never_falling(F.array(*buckets)).alias("_level"))
    counted = F.get("_level", F.lit(len(buckets) - 1)) > 0
    return level.select("at", *by, *[
        F.when(counted, F.round(histogram_quantile(F.col("_level"), q) * 1000.0, 6)).alias(f"p{round(q * 100)}_ms") for q in quantiles])
