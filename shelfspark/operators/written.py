"""Intermediate tables, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="shelfspark_")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local master may go without
    one, as on a cluster each machine would write to a disk of its own."""
    ctx = spark.sparkContext
    folder = ctx.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not ctx.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _own_folder()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by keys into all of a shuffle's partitions.  They are not merged by
    their bytes afterwards: where Python works long on few bytes, that would leave one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def written(df: DataFrame) -> DataFrame:
    """``df`` written and read back, which cuts lineage, statistics and constraints alike."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table of :func:`written` that nothing reads any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
