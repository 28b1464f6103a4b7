"""Every registered query with SQL gives the same rows in DuckDB on the smallest data set."""

import pytest

import parity
from wardlight.plans.oracle import oracle

SQL = oracle()


@pytest.fixture(scope="module")
def duck(small):
    return parity.connect(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, small, name):
    import __spark_entry__

    assert parity.compare(spark, duck, __spark_entry__.queries()[name], SQL[name], small) is None


def test_harness_notices_differences(spark, duck, small):
    from pyspark.sql import functions as F

    import __spark_entry__

    fn = __spark_entry__.queries()["keyword_score"]
    nudged = lambda s, f: fn(s, f).withColumn("keyword_score", F.col("keyword_score") + 1e-15)
    assert parity.compare(spark, duck, nudged, SQL["keyword_score"], small)
    assert parity.compare(spark, duck, lambda s, f: fn(s, f).limit(5), SQL["keyword_score"], small)
