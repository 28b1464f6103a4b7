"""Labelled-dataset preparation: relabel, encode, deduplicate, overlap, shuffle, sample, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlight.operators.ordered import position
from wardlight.session import small_side

SEED = 42
SPLIT_BUCKETS_HEX = 5  # about a million buckets per label


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def map_values(column: Column, mapping: dict) -> Column:
    """Mapped value, NULL for values outside the mapping."""
    chain = None
    for key, value in mapping.items():
        chain = (F if chain is None else chain).when(column == key, value)
    return chain


def standardize_labels(df: DataFrame) -> DataFrame:
    """``safe`` becomes ``benign``; every other value stays."""
    return df.withColumn("label", F.when(F.col("label") == "safe", "benign").otherwise(F.col("label")))


def load_labelled(evaluation: DataFrame, training: DataFrame) -> DataFrame:
    """Union of the two raw sets: labels 0/1 mapped by name, training rows all adversarial, no missing prompts there."""
    known = evaluation.select(
        F.col("adversarial").alias("prompt"), map_values(F.col("label"), {0: "safe", 1: "adversarial"}).alias("label")
    )
    harmful = training.select(F.col("adversarial").alias("prompt"), F.lit("adversarial").alias("label"))
    return known.unionByName(harmful.where(F.col("prompt").isNotNull()))


def export_split(df: DataFrame, split: str = "test") -> DataFrame:
    require_columns(df, ["text", "label"])
    return df.where(F.col("split") == split).select(F.col("text").alias("prompt"), "label")


def label_map(train: DataFrame, order: str = "row_id") -> DataFrame:
    """label, label_id: ids by first appearance.  Labels are aggregated first, then numbered without one task for all."""
    first = train.groupBy("label").agg(F.min(order).alias("_first"))
    placed = position(first, [F.col("_first"), F.col("label")], name="_at")
    return placed.select("label", (F.col("_at") - 1).cast("bigint").alias("label_id"))


def label_encode(df: DataFrame, train: DataFrame | None = None, order: str = "row_id") -> DataFrame:
    """Encode with the map of the train set (also for other sets); labels outside it become NULL."""
    return df.join(small_side(label_map(df if train is None else train, order)), "label", "left")


def dedup_prompts(df: DataFrame, order: str = "row_id") -> DataFrame:
    """Keep the first row of every prompt; missing prompts are one prompt.

    ``order`` must be unique.  Prompts are grouped by digest, so that an aggregate of 40 bytes a row finds the first
    ones and no text is sorted; copies of one prompt shrink to one row in every map task.
    """
    first = df.groupBy(F.unhex(F.sha2(F.col("prompt"), 256))).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi").select(*df.columns)


def exact_overlap(train: DataFrame, test: DataFrame) -> DataFrame:
    """Distinct prompts present on both sides; each side is made distinct before the join."""
    left, right = train.select("prompt").distinct(), test.select("prompt").distinct()
    return left.join(right, "prompt", "left_semi")


def shuffle_key(df: DataFrame, seed: int = SEED, order: str = "row_id") -> Column:
    """Pseudo-random sort key; the row id is part of it, so that copies of a text spread out."""
    return F.md5(F.concat_ws("|", F.col("prompt"), F.col(order).cast("string"), F.lit(str(seed))))


def seeded_shuffle(df: DataFrame, seed: int = SEED, order: str = "row_id") -> DataFrame:
    """Rows with their 0-based position in a seeded random order; ``order`` must be unique."""
    return df.join(shuffle_positions(df, seed, order), order).select(*df.columns, "position")


def shuffle_positions(df: DataFrame, seed: int = SEED, order: str = "row_id") -> DataFrame:
    """order, position: only ids and sort keys are moved, never the prompts."""
    keyed = df.select(order, shuffle_key(df, seed, order).alias("_key"))
    placed = position(keyed, [F.col("_key"), F.col(order)], name="_position")
    return placed.select(order, (F.col("_position") - 1).alias("position"))


def seeded_sample(df: DataFrame, n: int = 500, seed: int = SEED, order: str = "row_id") -> DataFrame:
    """Exactly ``n`` rows, the same for the same seed: a top-k per partition, merged."""
    keyed = df.withColumn("_key", shuffle_key(df, seed, order))
    return keyed.orderBy("_key", order).limit(n).drop("_key")


def stratified_split(df: DataFrame, test_share: float = 0.2, seed: int = SEED, order: str = "row_id") -> DataFrame:
    """Add ``split``: exactly round(share * rows) test rows per label.

    ``order`` must be unique.  The test rows of a label are those with the smallest seeded hash.  A histogram of hash
    prefixes finds the one bucket in which the cut falls; only ids and hashes of that bucket are ranked, all other rows
    are decided by their prefix.  So no label, however large, meets in one task.
    """
    hashed = df.withColumn("_hash", shuffle_key(df, seed, order)).withColumn(
        "_bucket", F.conv(F.substring("_hash", 1, SPLIT_BUCKETS_HEX), 16, 10).cast("int")
    )
    histogram = hashed.groupBy("label", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("label").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("label")
    counted = histogram.withColumns({
        "_upto": F.sum("_n").over(upto),
        "_wanted": F.round(F.sum("_n").over(whole) * F.lit(test_share)).cast("bigint"),
    })
    cut = counted.where((F.col("_upto") >= F.col("_wanted")) & (F.col("_upto") - F.col("_n") < F.col("_wanted"))).select(
        F.col("label").alias("_label"),
        F.col("_bucket").alias("_cut"),
        (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_take"),
    )
    cut = small_side(cut)
    placed = hashed.join(cut, F.col("label").eqNullSafe(F.col("_label")), "left")
    smallest = Window.partitionBy("label").orderBy("_hash", order)
    at_cut = placed.where("_bucket = _cut").select("label", "_hash", order, "_take")
    taken = at_cut.where("_take > 0").withColumn("_rank", F.row_number().over(smallest)).where("_rank <= _take").select(
        order, F.lit(True).alias("_taken"))
    below = F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False))
    decided = placed.join(taken, order, "left").withColumn(
        "split", F.when(below | F.col("_taken").isNotNull(), "test").otherwise("train"))
    return decided.select(*df.columns, "split")


def split_shares(split: DataFrame) -> DataFrame:
    """Label counts and shares within each side of a split."""
    counted = split.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "split", "label", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("split"))).alias("share")
    )


def step_profile(steps: dict[str, DataFrame]) -> DataFrame:
    """Row and column counts before and after each preparation step."""
    profile = None
    for name, df in steps.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("step"), "rows", F.lit(len(df.columns)).cast("bigint").alias("columns")
        )
        profile = row if profile is None else profile.unionByName(row)
    return profile
