"""Readers and writers for the file formats of the data preparation and log steps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Prompts hold quotes, newlines and outer blanks; these options keep them as they are.  A multi-line file is read
# by one task, so the writer bounds the rows per file.
TEXT_OPTIONS = {
    "header": "true", "multiLine": "true", "quote": '"', "escape": '"', "lineSep": "\n", "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1",
}
ROWS_PER_FILE = 200_000


def read_csv(spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", **options) -> DataFrame:
    return spark.read.options(**TEXT_OPTIONS, **options).option("sep", sep).schema(schema).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    return read_csv(spark, path, schema, sep="\t", **options)


def read_csv_folder(spark: SparkSession, folder: str, schema: StructType | str) -> DataFrame:
    """All ``*.csv`` files of a folder as one table; other files are ignored, no file is an error."""
    try:
        return read_csv(spark, f"{folder.rstrip('/')}/*.csv", schema)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no CSV files in {folder}") from error
        raise


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "overwrite") -> str:
    writer = df.write.mode(mode).options(**TEXT_OPTIONS).option("sep", sep).option("escapeQuotes", "true")
    writer.option("maxRecordsPerFile", ROWS_PER_FILE).csv(path)
    return path


def hashable(df: DataFrame) -> list[str]:
    """Columns that Spark's hashes take: all but maps and what holds them."""
    return [c for c, kind in df.dtypes if "map<" not in kind]


def append_log(df: DataFrame, path: str, file_format: str = "parquet", day_of: str | None = "ts",
               files_per_day: int = 8) -> str:
    """Append log rows, partitioned by day where a time column is named, so that trailing filters prune files.

    Rows are gathered by day first, in ``files_per_day`` parts, so that a day has few files and no single task.
    """
    if day_of is None:
        df.write.mode("append").format(file_format).save(path)
        return path
    # by the rows' own values: an input that is computed again, in another order, is dealt in the same way
    part = F.pmod(F.xxhash64(*hashable(df)), F.lit(files_per_day))
    gathered = df.withColumn("day", F.to_date(day_of)).repartition("day", part)
    gathered.write.mode("append").format(file_format).partitionBy("day").save(path)
    return path


def read_log(spark: SparkSession, path: str, file_format: str = "parquet") -> DataFrame:
    return spark.read.format(file_format).load(path)


def read_chat_log(spark: SparkSession, path: str, schema: StructType | str, file_format: str = "json") -> DataFrame:
    """Chat documents; the prompt may sit under its older key."""
    docs = spark.read.format(file_format).schema(schema).load(path)
    if "user_message" in docs.columns:
        docs = docs.withColumn("prompt", F.coalesce("prompt", "user_message")).drop("user_message")
    return docs


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of any keys, one VARIANT column ``doc``; nothing is lost where keys come and go."""
    return spark.read.format("json").option("singleVariantColumn", "doc").load(path)


def document_schema(docs: DataFrame) -> DataFrame:
    """schema: the merged schema of all documents, one row."""
    return docs.agg(F.schema_of_variant_agg("doc").alias("schema"))


def write_threshold(best: DataFrame, path: str) -> str:
    """The calibrated threshold as a one-line text file."""
    best.select(F.col("threshold").cast("string")).coalesce(1).write.mode("overwrite").text(path)
    return path


def read_training_state(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows (step, metrics) of a JSON training state with a mixed ``log_history`` array."""
    schema = ("log_history array<struct<step: bigint, epoch: double, loss: double, eval_loss: double, eval_f1: double, "
              "eval_accuracy: double>>")
    state = spark.read.schema(schema).json(path, multiLine=True)
    return state.select(F.inline("log_history")).where(F.col("eval_f1").isNotNull())


def append_metrics(metrics: DataFrame, run: str, path: str) -> str:
    """One row (run, metric, value) per metric column."""
    names = metrics.columns
    rows = metrics.select(F.explode(F.array(*[
        F.struct(F.lit(run).alias("run"), F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
    ])).alias("m")).select("m.*")
    return append_log(rows, path, day_of=None)
