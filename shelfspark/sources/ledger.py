"""Batches that are written exactly once, whatever fails between.

A ledger is a folder.  A batch is written to ``staged/`` first and committed by
renaming its folder into ``done/``; a rename onto a committed batch fails.  A
writer that is started again skips what is committed and drops what is only
staged, so no row is lost or doubled.  Readers see committed batches only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Ledger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for kind in ("staged", "done"):
            self._fs.mkdirs(self._path(f"{self.folder}/{kind}"))
        uri = self._fs.makeQualified(self._path(self.folder)).toUri()
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/done")))

    def drop_staged(self) -> None:
        """Remove what a writer left that did not come to its commit; only one writer may be at work."""
        for s in self._fs.listStatus(self._path(f"{self.folder}/staged")):
            self._fs.delete(s.getPath(), True)

    def forget(self, name: str) -> None:
        """Remove a committed batch that another one has replaced."""
        self._fs.delete(self._path(f"{self.folder}/done/{name}"), True)

    def stage(self, df: DataFrame, name: str) -> tuple[str, int]:
        """Write ``df`` aside: its folder and its rows."""
        at, seen = f"{self.folder}/staged/{name}-{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(at)
        return at, seen.get["n"]

    def commit(self, staged: str, name: str) -> bool:
        """Make a staged batch visible; False if one of that name already is."""
        hadoop = self.spark._jvm.org.apache.hadoop
        none = self.spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 0)
        target = self._fs.makeQualified(self._path(f"{self.folder}/done/{name}"))
        if self._fs.exists(target):
            return False
        self._context.rename(self._fs.makeQualified(self._path(staged)), target, none)  # fails if there is one by now
        return True

    def put(self, df: DataFrame, name: str, before_commit: Callable[[str], None] | None = None) -> int:
        """Write and commit a batch unless it is committed already: its rows, -1 if it was there.

        ``before_commit`` is called with the name of a batch that is staged."""
        if name in self.committed():
            return -1
        staged, n = self.stage(df, name)
        if before_commit:
            before_commit(name)
        return n if self.commit(staged, name) else -1

    def read(self, schema: StructType, names: list[str] | None = None) -> DataFrame:
        """Rows of committed batches, of all or of those named."""
        names = self.committed() if names is None else names
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/done/{n}" for n in names])


def write_batches(stream: DataFrame, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None, before_commit: Callable[[str], None] | None = None):
    """Start a query that writes each micro-batch of ``stream`` (after ``transform``)
    to a ledger, incrementally, until the files there are at its start are read.

    A batch that is repeated after a failure has the same number, so it is skipped
    if it was committed and written again if it was only staged."""
    ledger = Ledger(stream.sparkSession, folder)
    ledger.drop_staged()

    def each(batch: DataFrame, n: int) -> None:
        ledger.put(transform(batch) if transform else batch, f"batch-{n:09d}", before_commit)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
