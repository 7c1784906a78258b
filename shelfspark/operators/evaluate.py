"""Predictions against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column, otherwise: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(otherwise)


def f1(p: Column, r: Column) -> Column:
    return safe_ratio(2 * p * r, p + r, F.lit(0.0))


def coverage(truth: DataFrame, predicted: DataFrame, key: str = "video", item: str = "sku") -> DataFrame:
    """Per key: expected, predicted, matched, extra and missing items with
    precision, recall and F1.  Sets by rows, joined and summed, so that no key's
    set is gathered; a key without predictions predicts nothing."""
    t = truth.where(F.col(item).isNotNull()).select(key, item).distinct().withColumn("_t", F.lit(1))
    p = predicted.where(F.col(item).isNotNull()).select(key, item).distinct().withColumn("_p", F.lit(1))
    keys = truth.select(key).distinct()
    both = keys.join(t.join(p, [key, item], "full"), key, "left").groupBy(key).agg(
        F.count("_t").alias("expected_skus"),
        F.count("_p").alias("predicted_skus"),
        F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("matched_skus"),
        F.count_if(F.col("_t").isNull() & F.col("_p").isNotNull()).alias("extra_skus"),
        F.count_if(F.col("_p").isNull() & F.col("_t").isNotNull()).alias("missing_skus"),
    )
    return _rates(both)


def _rates(counts: DataFrame) -> DataFrame:
    matched = F.col("matched_skus")
    empty = F.when(F.col("expected_skus") == 0, 1.0).otherwise(0.0)
    precision = safe_ratio(matched, matched + F.col("extra_skus"), empty)
    recall = safe_ratio(matched, matched + F.col("missing_skus"), F.lit(1.0))
    return counts.withColumn("precision", precision).withColumn("recall", recall).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def coverage_micro(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts summed over videos before the ratios; items of different videos never meet."""
    sums = [F.sum(f"{c}_skus").alias(f"{c}_skus") for c in ("expected", "predicted", "matched", "extra", "missing")]
    return _rates(rows.groupBy(*keys).agg(*sums))


def set_differences(truth: DataFrame, predicted: DataFrame, key: str = "video", item: str = "sku") -> DataFrame:
    """Per key the sorted missing and extra items, comma-joined."""
    t, p = truth.select(key, item).distinct(), predicted.select(key, item).distinct()
    tagged = (
        t.join(p, [key, item], "left_anti").withColumn("kind", F.lit("missing")).unionByName(p.join(t, [key, item], "left_anti").withColumn("kind", F.lit("extra")))
    )
    sides = [F.array_join(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col(item)))), ",").alias(f"{k}_ids") for k in ("missing", "extra")]
    return tagged.groupBy(key).agg(*sides)


def count_errors(truth: DataFrame, reports: DataFrame, key: str = "video", true: str = "true_objects", pred: str = "predicted_objects") -> DataFrame:
    """Per key with a report: counts, difference and relative error (with no true objects: whether any was predicted)."""
    err = safe_ratio(F.abs(F.col("delta")), F.col(true), (F.col(pred) > 0).cast("double"))
    return truth.join(reports, key).withColumn("delta", F.col(pred) - F.col(true)).withColumn("count_error", err)


def missing_reports(truth: DataFrame, reports: DataFrame, key: str = "video") -> DataFrame:
    return truth.join(reports, key, "left_anti").select(key)


def count_summary(errors: DataFrame, true: str = "true_objects", pred: str = "predicted_objects") -> DataFrame:
    out = errors.agg(
        F.count(F.lit(1)).alias("videos"),
        F.coalesce(F.sum(true), F.lit(0)).alias("true_objects"),
        F.coalesce(F.sum(pred), F.lit(0)).alias("predicted_objects"),
        F.coalesce(F.avg("count_error"), F.lit(0.0)).alias("mean_video_count_error"),
    )
    delta = F.col("predicted_objects") - F.col("true_objects")
    pooled = safe_ratio(F.abs(delta), F.col("true_objects"), (F.col("predicted_objects") > 0).cast("double"))
    return out.withColumn("delta", delta).withColumn("count_error", pooled)


def detector_summary(rows: DataFrame) -> DataFrame:
    """Sums of per-image ``gt pred tp fp fn`` and pooled ratios, 0 where undefined."""
    zero = F.lit(0.0)
    err = safe_ratio(F.abs(F.col("pred") - F.col("gt")), F.col("gt"), (F.col("pred") > 0).cast("double"))
    sums = rows.withColumn("_e", err).agg(
        F.count(F.lit(1)).alias("images"), *[F.sum(c).alias(c) for c in ("gt", "pred", "tp", "fp", "fn")], F.avg("_e").alias("mean_image_count_error")
    )
    return sums.withColumns(
        {
            "count_error": err,
            "precision": safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"), zero),
            "recall": safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"), zero),
        }
    )


def best_config(scored: DataFrame, order: str = "ord") -> DataFrame:
    """The row of the highest F1, then recall, then the first; with its lead over ``baseline`` rows."""
    best = scored.agg(F.max_by(F.struct(*scored.columns), F.struct("f1", "recall", -F.col(order))).alias("b")).select("b.*")
    base = scored.where("baseline").agg(F.max_by("f1", -F.col(order)).alias("baseline_f1"))
    return best.crossJoin(base).withColumn("f1_delta", F.col("f1") - F.col("baseline_f1"))  # one row each


def worst_images(rows: DataFrame, n: int = 30) -> DataFrame:
    return rows.orderBy(F.desc("count_error"), F.desc(F.col("fp") + F.col("fn")), "image_id").limit(n)
