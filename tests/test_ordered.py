"""Running totals and percentiles with a hot key, missing keys and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.operators.evaluation import best_checkpoints
from wardlight.operators.ordered import exact_percentile, position, running


def frame(n=6000):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(n) < 0.5, "hot", rng.choice(list("abcd"), n))
    return pd.DataFrame({"id": np.arange(n), "key": key, "t": rng.integers(0, 50, n), "v": rng.integers(-5, 9, n)})


@pytest.fixture
def many_ranges(spark):
    """Force several ranges, so that offsets between ranges matter."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_running_sum_with_hot_key(spark, many_ranges):
    pdf = frame()
    got = running(spark.createDataFrame(pdf), [F.col("t"), F.col("id")], {"s": F.col("v")}, ["key"]).toPandas()
    pdf = pdf.sort_values(["key", "t", "id"])
    pdf["s"] = pdf.groupby("key")["v"].cumsum()
    merged = pdf.merge(got, on="id", suffixes=("", "_got"))
    assert len(merged) == len(pdf) and (merged["s"] == merged["s_got"]).all()


def test_running_spreads_a_hot_key(spark, many_ranges):
    df = spark.createDataFrame(pd.DataFrame({"id": range(8000), "key": ["hot"] * 8000}))
    spread = df.repartitionByRange("key", "id").groupBy(F.spark_partition_id()).count().toPandas()
    assert len(spread) == 8 and spread["count"].max() < 2500


def test_global_position_and_descending_order(spark, many_ranges):
    pdf = frame(500)
    got = position(spark.createDataFrame(pdf), [F.col("id").desc()]).toPandas()
    assert (got["position"] == 500 - got["id"]).all()


def test_missing_keys_form_one_group(spark, many_ranges):
    df = spark.createDataFrame([(i, None if i % 3 else "a") for i in range(300)], "id int, key string")
    got = position(df, [F.col("id")], ["key"]).toPandas()
    assert len(got) == 300 and got[got["key"].isna()]["position"].max() == 200


def test_exact_percentile(spark, many_ranges):
    pdf = frame()
    got = exact_percentile(spark.createDataFrame(pdf).withColumn("v", F.col("v").cast("double")), "v", 0.95, ["key"], "p")
    got = got.toPandas().set_index("key")["p"]
    expected = pdf.groupby("key")["v"].quantile(0.95)
    assert np.allclose(got.sort_index(), expected.sort_index())


def test_best_checkpoints(spark, many_ranges):
    values = [0.0, 0.2, 0.2, 0.1, None, 0.5, 0.4, 0.6]
    rows = [(r, i, v) for r in ("x", "y") for i, v in enumerate(values)]
    got = best_checkpoints(spark.createDataFrame(rows, "run string, step int, f1 double")).orderBy("run", "step").collect()
    assert [r["should_save"] for r in got[:8]] == [False, True, False, False, False, True, False, True]
