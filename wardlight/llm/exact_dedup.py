"""Exact duplicates with a heavy-hitter split, in DataFrame functions only.

A Misra-Gries pass (``freqItems``) names every digest that more than ``support`` of the rows can hold.  The winners of
these few digests are verified by exact counts and joined to the rows by broadcast, so their rows, which may be a third
of the table, never enter a shuffle.  All other digests are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import text_of, written

WHITE_SPACE = " \t\n\x0b\x0c\r"  # fixed value: the characters that two equal texts may differ in
SUPPORT = 0.002


def digests(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, sha256 of the text without white space, code points of the original text."""
    original = text_of(df, text)
    return df.select(
        df[key].alias("key"),
        F.sha2(F.translate(original, WHITE_SPACE, "").cast("binary"), 256).alias("digest"),
        F.length(original).cast("bigint").alias("n_chars"),
    )


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest its size and the row that stays: most code points, then smallest key, null keys last."""
    order = F.struct((-F.col("n_chars")).alias("n"), F.col("key").isNull().alias("no_key"), F.col("key"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(order)["key"].alias("keep"))


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``df``: key, keep (the key of the row that stays), group_size, kept, digest (hex).

    Null texts count as empty, and all empty texts are one group.  Of rows that tie in length and key exactly as many
    are kept as carry that key: give repeated rows keys of their own to keep one.  A null key can only win when its
    whole group has null keys.  An empty table gives an empty result; other columns of ``df`` are not looked at.
    ``support`` (at least 0.0001) bounds the broadcast to 1 / support digests.
    """
    rows = written(digests(df, key, text), "digests")
    return deduplicate_digests(rows, support).withColumnRenamed("key", key)


def deduplicate_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    spark = rows.sparkSession
    found = rows.stat.freqItems(["digest"], support).first()
    frequent = list(found[0] or []) if found else []  # at most 1 / support values
    candidates = spark.createDataFrame([(d,) for d in frequent], "digest string")
    total = rows.count()
    heavy = _winners(rows.join(F.broadcast(candidates), "digest", "left_semi"))
    winners = spark.createDataFrame(
        heavy.where(F.col("group_size") > F.lit(support * total)).collect(), heavy.schema  # fewer than 1 / support rows
    )
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners), "digest", "left_anti")
    cold = rest.join(_winners(rest), "digest")
    columns = ["key", "keep", "group_size", F.col("key").eqNullSafe(F.col("keep")).alias("kept"), "digest"]
    return hot.select(*columns).unionByName(cold.select(*columns))
