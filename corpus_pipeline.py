"""Corpus pipeline: toxic documents go, copies go, near copies go, secrets are masked, and the rest is packed.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.  All but the last return the
columns of ``documents`` in their order.  Decisions hold for single rows: a ``doc_id`` may be null or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import exact_dedup, packing, secrets_ledger, signature_join, toxicity
from wardlight.llm.common import table, written
from wardlight.llm.queries import WORD_TOKENIZER, tokenizer

END_ID = 1


def with_row(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, which no two rows share: doc_id, nulls last, then the place of the row in its files.

    Texts are not copied for it, unless ``docs`` is more than a plain read of Parquet files.
    """
    plain = docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    if not plain or "row_index" not in docs.select("_metadata").schema["_metadata"].dataType.names:
        docs = written(docs, "rows")
    return docs.withColumn("_row", F.struct(
        F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (case apart, as Spark sees names)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` of ``with_row`` less those whose ``_row`` is in ``gone``."""
    places = written(gone.select(F.col("_row.file").alias("file"), F.col("_row.at").alias("at")), "gone")
    same = (rows["_row"]["file"] == places["file"]) & (rows["_row"]["at"] == places["at"])
    return rows.join(places, same, "left_anti").drop("_row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    rows = with_row(docs)
    scored = toxicity.toxicity(rows, table(spark, sf_dir, "labels"), row="_row")
    return without(rows, scored.where("predicted = 1"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: of the longest the one with the least id."""
    rows = with_row(docs)
    return without(rows, exact_dedup.exact_dedup(rows, key="_row").where("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that near duplicates connect."""
    rows = with_row(docs)
    found = signature_join.near_duplicates(rows, key="_row")
    return without(rows, found.where("_row.file != component_id.file or _row.at != component_id.at"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked and n_chars of the new text.

    Null and empty texts stay as they are; long ones are read whole; columns of any name are kept.
    """
    found = secrets_ledger.scan(docs, blob=free_name(docs, "blob"), spans=(spans := free_name(docs, "spans")))
    masked = found.withColumn("text", F.when(F.size(spans) == 0, F.col("text")).otherwise(
        secrets_ledger.redacted(F.col("text"), F.col(spans))))
    counted = F.when(F.size(spans) == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint"))
    return masked.withColumn("n_chars", counted).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes in sequences of 4,096 tokens."""
    return packing.packed_documents(docs, tokenizer(WORD_TOKENIZER), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack_sequences),
]
ORACLE_SQL = None  # scores, set joins and packing have no SQL; tests compare run() with a plain version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
