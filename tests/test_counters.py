"""Rates of scraped counters against a plain reading of every window."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from wardlight.operators import counters

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
SCHEMA = "series string, ts timestamp, a double, b double"


def samples(n=400, seed=1):
    """One long and one short series with resets, gaps and missing values."""
    rng, rows = random.Random(seed), []
    for series, count in (("long", n), ("short", 5), (None, 30)):
        t, a, b = 0.0, 0.0, 100.0
        for _ in range(count):
            t += rng.choice([15.0, 15.0, 15.5, 61.0, 400.0])
            a, b = (0.0 if rng.random() < 0.05 else a + rng.randrange(4)), (rng.random() if rng.random() < 0.1 else b + rng.random())
            rows.append((series, START + datetime.timedelta(seconds=t), a, None if rng.random() < 0.1 else b))
    return rows


def plain_rates(rows, column, minutes=5, step=60):
    out, by = {}, {}
    for r in sorted(rows, key=lambda r: r[1]):
        by.setdefault(r[0], []).append([(r[1] - START).total_seconds(), r[column]])
    for series, points in by.items():
        total, last, read = 0.0, None, []
        for t, v in points:
            v = last if v is None else v
            if v is None:
                read.append((t, None, None))
                continue
            if last is not None and v < last:
                total += last
            read.append((t, v, v + total))
            last = v
        end = int(points[-1][0] // step + minutes * 60 // step + 1)
        for at in range(step, end * step, step):
            inside = [p for p in read if at - minutes * 60 < p[0] <= at]
            if not inside:
                continue
            if len(inside) < 2 or inside[0][2] is None:
                out[series, at] = None
                continue
            span, increase = inside[-1][0] - inside[0][0], inside[-1][2] - inside[0][2]
            apart, left, right = span / (len(inside) - 1), inside[0][0] - (at - minutes * 60), at - inside[-1][0]
            left, right = (apart / 2 if x >= 1.1 * apart else x for x in (left, right))
            first = points[[p[0] for p in points].index(inside[0][0])][1]
            if increase > 0 and first is not None and first >= 0:
                left = min(left, span * first / increase)
            out[series, at] = increase * (span + left + right) / span / (minutes * 60)
    return out


@pytest.mark.parametrize("value, column", [("a", 2), ("b", 3)])
def test_rates_equal_a_plain_reading(spark, value, column):
    rows = samples()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = counters.windows(df, ["series"], ["a", "b"]).select("series", F.unix_seconds("at").alias("at"), counters.rate(value).alias("r"))
    got = {(r.series, r["at"] - int(START.timestamp())): r.r for r in found.collect()}
    want = plain_rates(rows, column)
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert (got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-9)), k


def test_resets_cross_the_borders_of_ranges(spark):
    rows = [("s", START + datetime.timedelta(seconds=i), float(i % 10), 0.0) for i in range(2000)]
    total = counters.corrected(spark.createDataFrame(rows, SCHEMA), ["series"], ["a"])
    assert total.rdd.getNumPartitions() >= 1
    got = [r._total_a for r in total.orderBy("ts").collect()]
    assert got == [9.0 * (i // 10) + i % 10 for i in range(2000)]


def test_odd_samples(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert counters.windows(none, ["series"], ["a"]).count() == 0
    one = spark.createDataFrame([("s", START, 1.0, None), ("s", None, 2.0, None)], SCHEMA)
    rows = counters.windows(one, ["series"], ["a", "b"]).select("n", counters.rate("a").alias("r"), counters.rate("b").alias("q")).collect()
    assert len(rows) == 5 and all(r.n == 1 and r.r is None and r.q is None for r in rows)
    with pytest.raises(ValueError):
        counters.windows(one, ["series"], ["a"], minutes=1, step_s=45)


def test_quantiles_of_buckets_that_fall(spark):
    row = spark.range(1).select(F.array(*[F.lit(float(v)) for v in [0, 4, 3, *[10] * (len(counters_bounds()) - 3)]]).alias("v"))
    assert row.select(counters.never_falling(F.col("v")).alias("v")).first()["v"][:4] == [0.0, 4.0, 4.0, 10.0]


def counters_bounds():
    from wardlight.operators.monitoring import BOUNDS

    return BOUNDS
