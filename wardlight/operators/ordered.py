"""Running totals, positions and exact percentiles over a global order, without one task per group.

``Window.partitionBy(k).orderBy(...)`` puts a whole group into one task, and a third of all rows may share one
key.  Here the rows are range-partitioned by (key, order), each range is summed once, and the sum of all earlier
ranges is added to a window that never leaves its range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.session import cut_lineage

RANGE, GROUP = "_range", "_group"


def running(
    df: DataFrame,
    order: list[Column],
    totals: dict[str, Column],
    by: list[str] | None = None,
    how: str = "sum",
    inclusive: bool = True,
) -> DataFrame:
    """Add one running column per entry of ``totals``: the value up to and including, or before, the row.

    ``order`` must be unique within ``by``.  ``how`` is ``sum`` or ``max``; where no value precedes, ``max`` is
    NULL.  The range-partitioned rows are checkpointed, because range borders are drawn from a sample and have to
    be the same for both passes.
    """
    keys = by or []
    combine = F.sum if how == "sum" else F.max
    spread = df.withColumns({f"_v_{name}": value for name, value in totals.items()}).repartitionByRange(
        *[F.col(k) for k in keys], *order
    )
    saved = cut_lineage(spread.withColumn(RANGE, F.spark_partition_id()))
    per_range = saved.groupBy(*keys, RANGE).agg(*[combine(f"_v_{n}").alias(f"_r_{n}") for n in totals])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # One struct key for join and window: missing keys compare equal, and both use the same partitioning.
    group = F.struct(*keys, RANGE).alias(GROUP)
    offsets = per_range.select(group, *[combine(f"_r_{n}").over(earlier).alias(f"_o_{n}") for n in totals])
    joined = saved.select("*", group).join(offsets, GROUP)
    last = Window.currentRow if inclusive else -1
    here = Window.partitionBy(GROUP).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    local = {n: combine(f"_v_{n}").over(here) for n in totals}
    if how == "sum":
        result = {n: F.coalesce(c, F.lit(0)) + F.coalesce(F.col(f"_o_{n}"), F.lit(0)) for n, c in local.items()}
    else:
        result = {n: F.greatest(c, F.col(f"_o_{n}")) for n, c in local.items()}
    return joined.withColumns(result).select(*df.columns, *totals)


def position(df: DataFrame, order: list[Column], by: list[str] | None = None, name: str = "position") -> DataFrame:
    """1-based position of every row in a total order."""
    return running(df, order, {name: F.lit(1).cast("bigint")}, by)


def exact_percentile(df: DataFrame, value: str, q: float, by: list[str], name: str) -> DataFrame:
    """Interpolated percentile per group.  Equal values are counted first, so hot values cost one row."""
    known = df.where(F.col(value).isNotNull())
    counted = known.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counted, [F.col(value)], {"_upto": F.col("_n")}, by)
    sizes = counted.groupBy(*by).agg(F.sum("_n").alias("_size"))
    at = (F.col("_size") - 1) * F.lit(q)
    first = F.col("_upto") - F.col("_n")

    def holding(index: Column) -> Column:
        return F.max(F.when((first <= index) & (index < F.col("_upto")), F.col(value)))

    low, high = holding(F.floor(at)), holding(F.ceil(at))
    joined = placed.join(sizes, by)
    found = joined.groupBy(*by).agg(low.alias("_low"), high.alias("_high"), F.max(at - F.floor(at)).alias("_part"))
    return found.select(*by, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias(name))
