"""Unique product presence, partial reads, totals, and their union over videos.

``items`` rows carry an ``ord`` column: where the rule is "the first seen wins",
it is the smallest ``ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import falsy_null, model_label, or_empty

CONFIDENT = 0.75


def sku_key() -> Column:
    return F.coalesce(falsy_null("sku_id"), F.concat_ws("|", or_empty("brand"), or_empty("model")))


def _best(value: str, score: str = "ocr_conf", order: str = "ord") -> Column:
    """Of the row with the highest score, the first of equals."""
    return F.max_by(F.col(value), F.struct(F.col(score), -F.col(order)))


def _first(value: str, order: str = "ord") -> Column:
    return F.min_by(F.col(value), F.col(order))


def _ids(order: str = "ord") -> Column:
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("object_id").alias("i"))))
    return F.transform(pairs, lambda p: p["i"])


def is_confident(conf: float = CONFIDENT) -> Column:
    return (F.col("status") == "matched_sku") & (F.col("ocr_conf") >= conf)


def sku_presence(items: DataFrame, conf: float = CONFIDENT, keys: tuple[str, ...] = (), with_ids: bool = True) -> DataFrame:
    """One row for each recognised product (and ``keys``): attributes of the first
    object, crop and method of the most confident, objects counted and listed."""
    by = [*keys, "sku_key"]
    extra = [_ids().alias("object_ids")] if with_ids else []
    return (
        items.where(is_confident(conf))
        .withColumn("sku_key", sku_key())
        .groupBy(*by)
        .agg(
            *[_first(c).alias(c) for c in ("sku_id", "article_codes", "brand", "model", "category", "is_own")],
            F.count(F.lit(1)).alias("evidence_objects"),
            F.max("ocr_conf").alias("best_ocr_conf"),
            _best("crop").alias("best_crop"),
            _best("method").alias("method"),
            *extra,
        )
    )


def presence_order() -> list[Column]:
    return [or_empty("brand"), or_empty("model"), or_empty("article_codes")]


def brand_category_presence(items: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Partial reads by brand and category, at any confidence; rows with neither go."""
    brand, category = falsy_null("brand"), falsy_null("category")
    return (
        items.where(F.col("status").isin("brand_only", "category_only") & (brand.isNotNull() | category.isNotNull()))
        .withColumn("bc_key", F.concat_ws("|", or_empty("brand"), or_empty("category")))
        .groupBy(*keys, "bc_key")
        .agg(
            *[_first(c).alias(c) for c in ("brand", "category", "is_own")],
            F.count(F.lit(1)).alias("evidence_objects"),
            F.max("ocr_conf").alias("best_ocr_conf"),
            _best("crop").alias("best_crop"),
            _best("method").alias("method"),
        )
    )


def brand_category_order() -> list[Column]:
    return [falsy_null("brand").asc_nulls_last(), or_empty("category")]


def totals(items: DataFrame, conf: float = CONFIDENT, keys: tuple[str, ...] = ()) -> DataFrame:
    """The counters of a report; products and partial reads count once each."""

    def n(cond: Column) -> Column:
        return F.count_if(cond)

    sure = is_confident(conf)
    key = F.when(sure, sku_key())
    partial = F.col("status").isin("brand_only", "category_only") & (falsy_null("brand").isNotNull() | falsy_null("category").isNotNull())
    # a product is own if its first object is: the flag of the smallest ord for each key
    marked = items.withColumn("_key", key)
    counted = marked.groupBy(*keys).agg(
        F.countDistinct("_key").alias("unique_skus"),
        F.count(F.lit(1)).alias("candidate_objects"),
        n(F.col("is_own")).alias("own_brand_objects"),
        n(~F.coalesce(F.col("is_own"), F.lit(False))).alias("competitor_or_unknown"),
        n(sure).alias("sku_evidence_objects"),
        n(~F.coalesce(sure, F.lit(False))).alias("needs_review_objects"),
        F.countDistinct(F.when(partial, F.concat_ws("|", or_empty("brand"), or_empty("category")))).alias("brand_category_partial"),
        n(F.col("status") == "unknown").alias("brand_not_visible_objects"),
    )
    own = (
        marked.where("_key IS NOT NULL")
        .groupBy(*keys, "_key")
        .agg(_first("is_own").alias("own"))
        .groupBy(*keys)
        .agg(n(F.col("own")).alias("unique_own_skus"))
    )
    joined = counted.join(own, list(keys), "left") if keys else counted.crossJoin(own)  # one row each without keys
    return joined.withColumn("unique_own_skus", F.coalesce("unique_own_skus", F.lit(0))).withColumns(
        {
            "physical_objects": F.col("candidate_objects"),
            "confident_sku": F.col("unique_skus"),
            "needs_review": F.col("needs_review_objects"),
            "brand_not_visible": F.col("brand_not_visible_objects"),
        }
    )


def most_common(rows: DataFrame, value: Column, order: str = "ord", name: str = "value") -> DataFrame:
    """Counts of a value, the most frequent first, the first seen of equals before."""
    return (
        rows.select(value.alias(name), F.col(order).alias("_o"))
        .where(F.col(name).isNotNull())
        .groupBy(name)
        .agg(F.count(F.lit(1)).alias("n"), F.min("_o").alias("first_ord"))
        .orderBy(F.desc("n"), "first_ord", name)
    )


def brand_label() -> Column:
    return F.coalesce(falsy_null("brand"), F.lit("—"))


def label() -> Column:
    return model_label("brand", "model", "article_codes", "sku_id")


def merge_presence(presence: DataFrame) -> DataFrame:
    """Presence rows of single videos (``video``, ``video_ord``) merged by key:
    evidence summed, videos listed, the most confident crop kept."""
    order = F.col("video_ord")
    videos = F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("video").alias("v"))))
    best = F.max_by("best_crop", F.struct("best_ocr_conf", -order))
    return presence.groupBy("sku_key").agg(
        *[F.min_by(c, order).alias(c) for c in ("sku_id", "article_codes", "brand", "model", "category", "is_own")],
        F.sum("evidence_objects").alias("evidence_objects"),
        F.array_join(F.transform(videos, lambda p: p["v"]), ",").alias("videos"),
        F.max("best_ocr_conf").alias("best_ocr_conf"),
        best.alias("best_crop"),
    )


#: Counters that are counted anew over all videos instead of being summed.
COUNTED_ANEW = ("unique_skus", "unique_own_skus", "confident_sku", "brand_category_partial")


def merge_totals(per_video: DataFrame, merged: DataFrame, merged_partial: DataFrame) -> DataFrame:
    """(name, value) of all counters summed over videos, but for those of
    ``COUNTED_ANEW``, which come from the merged rows."""
    names = [c for c in per_video.columns if c not in ("video", "video_ord")]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in names]))
    summed = per_video.select(pairs.alias("p")).select("p.*").groupBy("name").agg(F.sum("value").alias("sum"))
    anew = merged.agg(F.count(F.lit(1)).alias("u"), F.count_if("is_own").alias("o")).crossJoin(
        merged_partial.agg(F.count(F.lit(1)).alias("p"))
    )  # one row each
    override = anew.select(
        F.explode(
            F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("override")) for n, c in zip(COUNTED_ANEW, ("u", "o", "u", "p"))])
        ).alias("x")
    ).select("x.*")
    return summed.join(override, "name", "full").select("name", F.coalesce("override", "sum").alias("value"))
