"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session leaves that unset, a temporary folder is made and set as
    the session's checkpoint folder, but only on a local master: on a cluster
    each machine would write to a disk of its own.
    """
    ctx = spark.sparkContext
    path = ctx.getConf().get("spark.checkpoint.dir", None)
    if not path:
        jdir = ctx._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not ctx.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="shelfspark_ckpt_")
        ctx.setCheckpointDir(path)
        return path
    if not ctx._jsc.sc().getCheckpointDir().isDefined():
        ctx.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: later stages
    read those files instead of recomputing, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shelfspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that :func:`cut` wrote and nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        parent = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        parent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(parent, True)


def by_place(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named ``c0``, ``c1``, ... by their place, so that no
    name (dotted, repeated but for case, or used by an operator) can clash;
    ``toDF(*docs.columns)`` gives the names back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def place(docs: DataFrame, name: str) -> str:
    """The name of column ``name`` in :func:`by_place`; case counts only where two names differ by it."""
    at = [i for i, c in enumerate(docs.columns) if c == name] or [i for i, c in enumerate(docs.columns) if c.lower() == name.lower()]
    if not at:
        raise ValueError(f"no column {name!r} in {docs.columns}")
    return f"c{at[0]}"


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``_id`` and ``_text`` (null text: empty), so no other column can clash."""
    return by_place(docs).select(
        F.col(place(docs, id_col)).alias("_id"),
        F.coalesce(F.col(place(docs, text_col)).cast("string"), F.lit("")).alias("_text"),
    )


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library, which gives memory back by itself
        return lambda _: 0


def give_back() -> None:
    """Return what a worker has freed to the system: the same worker goes on with
    other operators, and its executor has a bound."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def texts_of(batch: pa.RecordBatch, name: str = "_text") -> list[str]:
    return [t or "" for t in batch.column(name).to_pylist()]


def text_blocks(batch: pa.RecordBatch, budget: int, name: str = "_text"):
    """(first row, texts) of consecutive parts of a batch of about ``budget``
    bytes of text, so that only one part at a time becomes Python objects."""
    column = batch.column(name)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for a, b in blocks(sizes, budget):
        yield a, [t or "" for t in column.slice(a, b - a).to_pylist()]


def blocks(lengths: list[int], budget: int):
    """Consecutive index ranges whose lengths add up to about ``budget`` (one at least)."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > budget:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)
