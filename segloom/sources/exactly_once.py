"""Append-only ledger folders in which a repeated write counts once.

Rows of a write go to a folder of their own; then a manifest names that folder under the write's name. A name that has a manifest is
not written again, and if two writers race for one name, readers take the first folder of its manifest in order. Folders that no
manifest names (of writes that failed half-way) are never read. So a micro-batch that is replayed leaves one row per id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


class Ledger:
    """A ledger below ``path``, in the shared store."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self.path = spark, path.rstrip("/")

    def _named(self) -> DataFrame | None:
        try:
            return self._spark.read.schema("folder string, write string").json(f"{self.path}/manifest")
        except AnalysisException:  # nothing has been written yet
            return None

    def append(self, rows: DataFrame, write: str) -> bool:
        """Add ``rows`` under the name ``write``; False if that has been done before."""
        named = self._named()
        if named is not None and not named.filter(F.col("write") == write).isEmpty():
            return False
        folder = f"{write}-{uuid.uuid4().hex}"
        rows.write.json(f"{self.path}/data/{folder}")
        entry = self._spark.createDataFrame([(folder, write)], "folder string, write string")
        entry.coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        return True

    def read(self, schema: StructType | str) -> DataFrame:
        """All rows of writes that have a manifest."""
        named = self._named()
        folders = [] if named is None else [r.f for r in named.groupBy("write").agg(F.min("folder").alias("f")).collect()]
        if not folders:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).json([f"{self.path}/data/{f}" for f in folders])

    def sink(self, stream: DataFrame, name: str) -> DataStreamWriter:
        """A writer of ``stream`` into this ledger; ``name`` stays the same over restarts, like its checkpoint."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.append(batch, f"{name}-{number}") and None)
