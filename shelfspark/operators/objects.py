"""An object's crops in the order worth reading, and its recognition from all reads of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Rank of a recognition's status, and the confidence that ends a search.
STATUS_RANK = {"matched_sku": 4, "brand_only": 3, "category_only": 2, "unknown": 1}
SURE = 0.86


def status_rank(status="status") -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])[F.col(status)], F.lit(0))


def score(status="status", confidence="confidence", text="text") -> Column:
    return X.recognition_score(status_rank(status), confidence, text)


def ranked_crops(objects: DataFrame, candidates: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Up to ``limit`` distinct crops of each object (``keys``, ``rep_crop``), numbered
    from 0: its ``candidates`` (``crop``, ``ocr_score``, ``score``, ``ord``) by how
    well they read and then by their own score, or its ``rep_crop`` without any."""
    best = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("ocr_score"), F.desc_nulls_last("score"), "ord")
    named = candidates.where(X.falsy_null("crop").isNotNull()).withColumn("n", F.row_number().over(best))
    first = named.groupBy(*keys, "crop").agg(F.min("n").alias("n"))
    kept = first.withColumn("idx", F.row_number().over(Window.partitionBy(*keys).orderBy("n")) - 1).where(F.col("idx") < limit)
    found = objects.select(*keys, "rep_crop").join(kept.select(*keys, "crop", "idx"), keys, "left")
    return found.select(*keys, F.coalesce("idx", F.lit(0)).alias("idx"), F.coalesce("crop", "rep_crop").alias("crop"))


def recognise(reads: DataFrame, keys: list[str], allow_retry: bool = True) -> DataFrame:
    """One recognition for each object from its ``reads``: ``phase`` (``crop``, numbered
    by ``idx``; ``enhanced``; ``visual``), ``status``, ``sku_id``, ``confidence``, ``text``.

    Crops count up to the first that is matched, if it is the first of all or sure.
    Matched products are voted for: most votes, then the best score, then the first.
    Without votes the enhanced read and then the visual one may give the vote or,
    with a better score, the answer; else the best crop stands."""
    rows = reads.withColumn("score", score())
    matched = (F.col("status") == "matched_sku") & X.falsy_null("sku_id").isNotNull()
    stops = (F.col("status") == "matched_sku") & ((F.col("idx") == 0) | (F.col("confidence") >= SURE))
    crops = rows.where("phase = 'crop'").withColumn("_cut", F.min(F.when(stops, F.col("idx"))).over(Window.partitionBy(*keys)))
    crops = crops.where(F.col("_cut").isNull() | (F.col("idx") <= F.col("_cut")))
    answer = F.struct("status", "sku_id", "confidence", "text", "score", "phase")
    best = crops.groupBy(*keys).agg(F.max_by(answer, F.struct("score", -F.col("idx"))).alias("best"), F.count(F.lit(1)).alias("n_crops"))
    counted = crops.where(matched).groupBy(*keys, "sku_id").agg(
        F.count(F.lit(1)).alias("votes"), F.max_by(answer, F.struct("score", -F.col("idx"))).alias("b"), F.min("idx").alias("first")
    )
    voted = counted.groupBy(*keys).agg(
        F.max_by(F.struct("b", "votes"), F.struct("votes", "b.score", -F.col("first"))).alias("v"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("sku_id", "votes")))).alias("sku_votes"),
    )
    out = best.join(voted, keys, "left")
    no_votes = F.lit(None).cast("map<string,bigint>")
    chosen, tally = F.coalesce("v.b", "best"), F.coalesce("sku_votes", no_votes)
    if allow_retry:
        one = {p: rows.where(F.col("phase") == p).groupBy(*keys).agg(F.max_by(answer, F.struct("score", -F.col("idx"))).alias(p)) for p in ("enhanced", "visual")}
        out = out.join(one["enhanced"], keys, "left").join(one["visual"], keys, "left")
        e, v = F.col("enhanced"), F.col("visual")
        e_votes = (e["status"] == "matched_sku") & X.falsy_null(e["sku_id"]).isNotNull()
        after = F.when(e["score"] > F.col("best.score"), e).otherwise(F.col("best"))
        better = v["score"] > after["score"]
        v_votes = better & X.falsy_null(v["sku_id"]).isNotNull()
        retried = F.when(e_votes, e).when(better, v).otherwise(after)
        single = F.when(e_votes, F.create_map(e["sku_id"], F.lit(1).cast("bigint"))).when(v_votes, F.create_map(v["sku_id"], F.lit(1).cast("bigint")))
        chosen = F.when(F.col("v").isNull(), retried).otherwise(F.col("v.b"))
        tally = F.when(F.col("v").isNull(), single).otherwise(F.col("sku_votes"))
    return out.select(*keys, chosen.alias("r"), "n_crops", F.coalesce(tally, F.create_map().cast("map<string,bigint>")).alias("sku_votes")).select(
        *keys, "r.*", "n_crops", "sku_votes"
    )
