"""Splits, quotas, dedup and summaries of training sets."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ledger import Ledger
from .numbering import numbered
from .written import dropped, written


def split_every(df: DataFrame, order: list, ratio: float | None = None, n: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every n-th row (1-based, n = round half even of 1 / ratio, 2 at least) is ``val``."""
    step = n or max(2, round(1 / ratio))
    if keys:
        rows = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    else:
        rows = numbered(df, order, "_i")
    return rows.withColumn("split", F.when(F.col("_i") % step == 0, "val").otherwise("train")).drop("_i")


def split_hashed(df: DataFrame, key: str, ratio: float, seed: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """The first ``max(1, int(n * ratio))`` rows of a group, in the order of a
    seeded hash, are ``val``."""
    w = Window.partitionBy(*groups)
    i = F.row_number().over(w.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key))
    most = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) * ratio))
    return df.withColumn("split", F.when(i <= most, "val").otherwise("train"))


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


def capped(df: DataFrame, keys: list[str], order: list, per_key: int, overall: int | None = None, overall_order: list | None = None) -> DataFrame:
    """At most ``per_key`` rows of each key in order, then at most ``overall``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    out = df.withColumn("_n", n).where(F.col("_n") <= per_key).drop("_n")
    return out.orderBy(*(overall_order or order)).limit(overall) if overall else out


def with_min_count(df: DataFrame, cls: str, least: int = 50) -> DataFrame:
    """Rows of classes that have ``least`` rows or more."""
    big = df.groupBy(cls).count().where(F.col("count") >= least)
    return df.join(big.select(cls), cls, "left_semi")


def split_summary(df: DataFrame, split: str = "split", boxes: str = "boxes") -> DataFrame:
    """Images, labelled and empty ones and boxes by split, and in total."""
    return df.rollup(split).agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col(boxes) > 0).alias("labels"),
        F.coalesce(F.sum(boxes), F.lit(0)).alias("boxes"),
        F.count_if(F.col(boxes) == 0).alias("empty"),
        F.grouping(split).alias("is_total"),
    )


def union_versions(base: DataFrame, additions: DataFrame, version: str) -> DataFrame:
    """A dataset and its additions as a new version."""
    return base.unionByName(additions, allowMissingColumns=True).withColumn("version", F.lit(version))


def with_labels(images: DataFrame, boxes: DataFrame, key: str, line: Column) -> DataFrame:
    """Label text of every image; images without boxes keep an empty one."""
    pairs = F.sort_array(F.collect_list(F.struct("ord", line.alias("line"))))
    text = boxes.groupBy(key).agg(F.array_join(F.transform(pairs, lambda p: p["line"]), "\n").alias("label_text"))
    return images.join(text, key, "left").withColumn("label_text", F.coalesce("label_text", F.lit("")))


def export_names(df: DataFrame, cls: str, order: list) -> DataFrame:
    """File names ``class_00000`` by class and order, of more digits from 100,000 on."""
    n = F.row_number().over(Window.partitionBy(cls, "split").orderBy(*order)) - 1
    return df.withColumn("name", F.concat(F.col(cls), F.lit("_"), F.format_string("%05d", n)))


def stale(listing: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    return listing.join(manifest.select(key), key, "left_anti")


def image_of_label(labels: DataFrame, images: DataFrame, extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """The image of each label by stem, the first of the preferred suffixes; none: null."""
    rank = F.array_position(F.array(*map(F.lit, extensions)), F.col("ext"))
    best = images.where(rank > 0).groupBy("stem").agg(F.min_by("path", rank).alias("image_path"))
    return labels.join(best, "stem", "left")


def by_category_sets(members: DataFrame, wanted: list[str], avoided: list[str], key: str = "image_id", cat: str = "category") -> DataFrame:
    """Keys that have a wanted category and none of the avoided ones."""
    good = members.where(F.col(cat).isin(*wanted)).select(key).distinct()
    return good.join(members.where(F.col(cat).isin(*avoided)).select(key).distinct(), key, "left_anti")


def scan_capped(df: DataFrame, order: list, wanted: Column, most_scanned: int, target: int) -> DataFrame:
    """The first ``target`` wanted rows among the first ``most_scanned`` in order: both caps are the feature."""
    return df.orderBy(*order).limit(most_scanned).where(wanted).orderBy(*order).limit(target)


class _Enough(Exception):
    """Ends a scan whose caps are reached."""


def scan_files(files: DataFrame, wanted: Column, most_scanned: int, target: int, folder: str) -> DataFrame:
    """The first ``target`` wanted rows of a stream of files among its first
    ``most_scanned`` rows, in the order in which it reads them.

    Each micro-batch is written to a ledger with the rows that were scanned for it;
    once a cap is reached the query ends before the next batch is read, so later
    files stay unopened.  A scan that is started again in its ``folder`` goes on."""
    spark = files.sparkSession
    taken, scanned = Ledger(spark, f"{folder}/taken"), Ledger(spark, f"{folder}/scanned")
    taken.drop_staged()
    scanned.drop_staged()
    place = T.StructType().add("_place", T.LongType())

    def counted(ledger: Ledger, schema: T.StructType) -> int:
        return ledger.read(schema).count()

    def each(batch: DataFrame, n: int) -> None:
        name = f"batch-{n:09d}"
        if name in scanned.committed():
            return
        left, missing = most_scanned - counted(scanned, place), target - counted(taken, batch.schema)
        if left <= 0 or missing <= 0:
            raise _Enough
        rows = written(batch.withColumn("_place", F.monotonically_increasing_id()).orderBy("_place").limit(left))
        taken.put(rows.where(wanted).orderBy("_place").limit(missing).drop("_place"), name)
        scanned.put(rows.select("_place"), name)
        dropped(rows)

    query = files.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if "_Enough" not in str(e):
            raise
    return taken.read(files.schema)


def tasks_with_manifest(tasks: DataFrame, manifest: DataFrame, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """Tasks with their manifest row, and (one row) how many were written and missed."""
    rows = manifest.dropDuplicates([key])
    named = tasks.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    found = named.join(rows, key)
    counts = tasks.join(rows.select(key, F.lit(True).alias("_known")), key, "left").agg(
        F.count_if(F.col("_known")).alias("written"), F.count_if(F.col("_known").isNull()).alias("missing")
    )
    return found, counts


def label_counters(images: DataFrame, labels: DataFrame, key: str = "image_id", cls: str = "cls", manual: str = "manual", own: int = 0) -> DataFrame:
    """Counters of a labelling run, one row: images with and without labels, labels by class."""
    per = labels.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(cls) == own).alias("own"), F.count_if(F.col(manual)).alias("manual")
    )
    return images.select(key).join(per, key, "left").na.fill(0, ["n", "own", "manual"]).agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("n") > 0).alias("images_with_labels"),
        F.coalesce(F.sum("own"), F.lit(0)).alias("own_product"),
        F.coalesce(F.sum(F.col("n") - F.col("own")), F.lit(0)).alias("competitor_or_unknown"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_labels"),
        F.coalesce(F.sum("manual"), F.lit(0)).alias("manual_overrides"),
        F.count_if(F.col("n") == 0).alias("empty_images"),
    )


def mean_or_zero(c) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))
