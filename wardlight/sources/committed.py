"""Logs of committed batches: a repeated append changes nothing, readers see committed rows only, small files merge.

A batch is written to a folder of its own, which nobody reads until a row of the manifest names it.  The manifest has a
row for each batch and each merge: its key, its folder, and the folders and keys that it replaces.  Whoever finds the key
of a batch in the manifest has nothing to do; if two writers commit the same key at the same time, all readers take the
same one of the two.  A merge that replaces what another merge has replaced already counts for nothing.
"""

from __future__ import annotations

import uuid
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wardlight.sources.tabular import hashable

MANIFEST = "key string, folder string, merged boolean, folders array<string>, keys array<string>"
ROWS_PER_FILE = 1_000_000


class CommittedLog:
    """An append-only log in a folder of shared storage; ``schema`` is that of its rows."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _manifest(self) -> list:
        """All manifest rows, of which there is one for each batch, whatever its size."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").collect()
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return []
            raise

    def _live(self) -> tuple[list[str], set[str]]:
        """Folders that hold the log, and the keys of all batches in it."""
        rows = sorted(self._manifest(), key=lambda r: r["folder"])
        live: dict[str, set[str]] = {}  # folder -> keys
        known: set[str] = set()
        for r in rows:
            if not r["merged"] and r["key"] not in known:
                known.add(r["key"])
                live[r["folder"]] = {r["key"]}
        waiting = [r for r in rows if r["merged"]]
        while ready := [r for r in waiting if all(f in live for f in r["folders"])]:
            first = ready[0]
            for folder in first["folders"]:
                del live[folder]
            live[first["folder"]] = set(first["keys"])
            waiting.remove(first)
        return sorted(live), known

    def _commit(self, key: str, folder: str, merged: bool = False, folders: list[str] = (), keys: list[str] = ()) -> None:
        row = self.spark.createDataFrame([(key, folder, merged, list(folders), list(keys))], MANIFEST)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _fresh(self, key: str) -> str:
        return f"{sha256(key.encode()).hexdigest()[:16]}-{uuid.uuid4().hex}"

    def append(self, df: DataFrame, key: str) -> bool:
        """Add the rows of ``df`` under ``key``, which names the input and the run; False if it is there already."""
        if key in self._live()[1]:
            return False
        folder = self._fresh(key)
        df.write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{self.path}/data/{folder}")
        self._commit(key, folder)
        return True

    def read(self) -> DataFrame:
        folders, _ = self._live()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def merge(self, files: int = 8) -> int:
        """Put all live folders into one of ``files`` files; the number of folders merged.  Old folders stay for readers
        that have begun, and may be removed when none is left."""
        folders, keys = self._live()
        if len(folders) < 2:
            return 0
        folder = self._fresh("merge")
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])
        # dealt by the rows' own values: a task that runs again deals them in the same way
        rows.repartition(files, F.xxhash64(*hashable(rows))).write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{self.path}/data/{folder}")
        self._commit(folder, folder, True, folders, sorted(keys))
        return len(folders)
