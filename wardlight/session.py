"""Session helpers: local session for tests, checkpoint folder, scratch tables, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"
BROADCAST_ROWS = 100_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", scan_parts: int = 16) -> SparkSession:
    """``scan_parts`` spreads the rows of single small files over the cores (see ``plans.inputs.scan_parts``)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wardlight")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("wardlight.scan.parts", str(scan_parts))
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names.  A temporary one stands in for it in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        configured = spark.conf.get(CHECKPOINT_CONF, "")
        if not configured and not context.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="wardlight-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, so that tables written there survive lost executors."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back, so that columns can be pruned."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result is read back from the shared folder, never from executor disks."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise an aggregated lookup table once and broadcast it only if it is really small.

    Beyond ``max_rows`` the table is returned without a hint: the join is then an ordinary shuffle join, whose
    hot keys adaptive execution splits.
    """
    saved = cut_lineage(df)
    return F.broadcast(saved) if saved.limit(max_rows + 1).count() <= max_rows else saved
