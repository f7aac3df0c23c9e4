"""Tables that several sinks of one batch are written to together.

A batch writes its part of every table to folders of its own and then a commit
record.  Readers see committed batches only, so a run that is killed between two
sinks leaves nothing behind that counts, and a batch that runs again writes the
same folders anew.  A batch that was committed isn't run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "batch string, phase string, tables array<string>"


class Ledger:
    """Tables below ``folder``; ``schemas`` has each table's columns, ``split`` the columns that some are partitioned by."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], split: dict[str, list[str]] | None = None):
        self.spark, self.folder, self.schemas, self.split = spark, folder.rstrip("/"), schemas, split or {}

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def committed(self, batch: str | None = None, phase: str | None = None) -> list[str]:
        """The batches (or those of one name) whose commit of ``phase`` is there, as ``batch-phase``; one name per run of an import."""
        if not self._there(f"{self.folder}/commits"):
            return []
        rows = self.spark.read.schema(COMMITS).parquet(f"{self.folder}/commits/*")
        if batch is not None:
            rows = rows.filter(F.col("batch") == batch)
        if phase is not None:
            rows = rows.filter(F.col("phase") == phase)
        return sorted(f"{r['batch']}-{r['phase']}" for r in rows.select("batch", "phase").distinct().collect())

    def read(self, table: str, batch: str | None = None) -> DataFrame:
        """The rows of committed batches, or of one of them, with the batch's name in ``batch``."""
        parts = [p for p in self.committed(batch) if self._there(f"{self.folder}/{table}/batch={p}")]
        schema = f"{self.schemas[table]}, batch string"
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*[f"{self.folder}/{table}/batch={p}" for p in parts])

    def write(self, batch: str, phase: str, tables: Callable[[], dict[str, DataFrame]]) -> bool:
        """Write ``tables()`` as one batch, unless it was committed; whether it was written now."""
        if self.committed(batch, phase):
            return False
        made = tables()
        for name, rows in made.items():
            out = rows.write.mode("overwrite")
            if name in self.split:
                out = out.partitionBy(*self.split[name])
            out.parquet(f"{self.folder}/{name}/batch={batch}-{phase}")
        self.spark.createDataFrame([(batch, phase, sorted(made))], COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/commits/{batch}-{phase}")
        return True
