"""Catalogs, their key tables, and joins of crawled products with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def parse_bool(c, recogniser: bool = False) -> Column:
    """1, true, yes and y; the recogniser takes only true."""
    low = F.lower(F.trim(X.or_empty(c)))
    return low == "true" if recogniser else low.isin("1", "true", "yes", "y")


def parse_catalog(rows: DataFrame, recogniser: bool = False) -> DataFrame:
    """All-string catalog rows (``ord`` kept) to typed ones."""
    lists = {c: X.split_pipe(c) for c in ("article_codes", "barcodes", "aliases", "reference_images")}
    out = rows.withColumns(lists).withColumn("is_own_brand", parse_bool("is_own_brand", recogniser))
    if recogniser:
        out = out.where(~F.trim(X.or_empty("brand_name")).isin("", "-"))
    return out


def last_by_sku(catalog: DataFrame) -> DataFrame:
    """One row for each ``sku_id``, the last one."""
    w = Window.partitionBy("sku_id").orderBy(F.desc("ord"))
    return catalog.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def catalog_keys(catalog: DataFrame) -> DataFrame:
    """Every key of every product: ``sku_id``, ``ord``, ``kind`` (model or article),
    ``key``, ``key_len``; aliases go by their form."""
    articles = F.flatten(F.transform("article_codes", X.article_keys))
    alias_articles = F.flatten(F.transform(F.filter("aliases", X.looks_like_article), X.article_keys))
    alias_models = F.flatten(F.transform(F.filter("aliases", lambda a: ~X.looks_like_article(a)), X.model_keys))
    tagged = [
        F.transform(F.array_union(X.model_keys("model_name"), alias_models), lambda k: F.struct(F.lit("model").alias("kind"), k.alias("key"))),
        F.transform(F.array_union(articles, alias_articles), lambda k: F.struct(F.lit("article").alias("kind"), k.alias("key"))),
    ]
    return (
        catalog.select("sku_id", "ord", F.explode(F.concat(*tagged)).alias("k"))
        .select("sku_id", "ord", "k.kind", "k.key", F.char_length("k.key").alias("key_len"))
        .distinct()
    )


def brand_dictionary(catalog: DataFrame, brand: str = "brand_name") -> DataFrame:
    """The first spelling of each canonical brand."""
    return (
        catalog.where(F.coalesce(X.falsy_null(brand), F.lit("-")) != "-")
        .groupBy(X.canon(brand).alias("brand_canon"))
        .agg(F.min_by(brand, "ord").alias("brand"), F.min("ord").alias("ord"))
    )


def category_vocabulary(catalog: DataFrame, category: str = "category") -> DataFrame:
    """Product nouns of categories: canonical ``keyword``, first ``display`` form."""
    words = catalog.select("ord", F.posexplode(X.category_words(category)).alias("p", "w"))
    return words.groupBy(X.canon("w").alias("keyword")).agg(
        F.min_by(F.initcap(F.lower("w")), F.struct("ord", "p")).alias("display"), F.min(F.struct("ord", "p")).alias("first")
    )


def unique_ids(products: DataFrame, order: str = "ord") -> DataFrame:
    """Repeated ids get ``_2``, ``_3``, ... in order."""
    n = F.row_number().over(Window.partitionBy("sku_id").orderBy(order))
    return products.withColumn("sku_id", F.when(n > 1, F.concat("sku_id", F.lit("_"), n.cast("string"))).otherwise(F.col("sku_id")))


def search(catalog: DataFrame, query: str, fields: list[str], brand: str | None = None, limit: int = 300) -> DataFrame:
    """Hits in catalog order, at most ``limit``, each with the number of all hits."""
    hits = catalog.where(X.search_match(fields, query))
    if brand:
        hits = hits.where(F.col("brand_name") == brand)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return hits.orderBy("ord").limit(limit).crossJoin(total)  # one row


def own_article_join(products: DataFrame, own: DataFrame) -> DataFrame:
    """Each crawled product with the first own product of its brand and article,
    whose category and model then replace its own."""
    keyed = own.select(
        F.col("brand_id"),
        F.explode(F.transform("article_codes", lambda a: F.upper(F.translate(F.regexp_replace(a, r"\s+", ""), "\\", "/")))).alias("_article"),
        F.struct("ord", "sku_id", "category", "model_name").alias("o"),
    )
    first = keyed.groupBy("brand_id", "_article").agg(F.min("o").alias("o"))
    return (
        products.join(first, (products["brand_id"] == first["brand_id"]) & (products["article"] == first["_article"]), "left")
        .drop(first["brand_id"])
        .withColumn("catalog_sku_id", F.col("o.sku_id"))
        .withColumn("category", F.coalesce("o.category", "category"))
        .withColumn("model_name", F.coalesce("o.model_name", "model_name"))
        .drop("o", "_article")
    )


def missing_own(own: DataFrame, seen: DataFrame) -> DataFrame:
    """Own products none of whose articles was crawled (``seen``: brand_id, article)."""
    found = (
        own.select("sku_id", "brand_id", F.explode("article_codes").alias("article"))
        .join(seen.select("brand_id", "article").distinct(), ["brand_id", "article"], "left_semi")
        .select("sku_id")
        .distinct()
    )
    return own.join(found, "sku_id", "left_anti").withColumn("status", F.lit("missing_official_reference"))


def with_references(catalog: DataFrame, images: DataFrame) -> DataFrame:
    """The catalog with its reference images and further ones (``sku_id``, ``ord``,
    ``path``) in one bar-joined list, each once; rows without any keep an empty one."""
    pairs = F.sort_array(F.collect_list(F.struct("ord", "path")))
    more = images.groupBy("sku_id").agg(F.transform(pairs, lambda p: p["path"]).alias("_more"))
    both = F.concat(F.coalesce("reference_images", F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))
    return catalog.join(more, "sku_id", "left").withColumn("reference_images", F.array_join(F.array_distinct(both), "|")).drop("_more")


def export_rows(products: DataFrame) -> DataFrame:
    """Catalog file rows: lists joined by bars, flags as words."""
    lists = {c: F.array_join(c, "|") for c in ("article_codes", "barcodes", "aliases", "reference_images")}
    return products.withColumns(lists).withColumn("is_own_brand", F.when(F.col("is_own_brand"), "true").otherwise("false"))


def source_counters(pages: DataFrame, images: DataFrame, source: str = "source") -> DataFrame:
    """Counters of a crawl by source: candidate ``pages`` (``state``: product,
    skipped_non_product or error; ``catalog_sku_id``), and their ``images``."""
    n = F.count_if
    found = pages.groupBy(source).agg(
        F.count(F.lit(1)).alias("candidate_urls"),
        n(F.col("state") == "product").alias("parsed_products"),
        n((F.col("state") == "product") & (X.or_empty("catalog_sku_id") != "")).alias("matched_own_catalog"),
        n(F.col("state") == "skipped_non_product").alias("skipped_non_product"),
        n(F.col("state") == "error").alias("errors"),
    )
    seen = images.groupBy(source).agg(F.count(F.lit(1)).alias("images"), n(F.col("download_status") == "ok").alias("downloaded"))
    return found.join(seen, source, "left").na.fill(0, ["images", "downloaded"])


def crawl_totals(products: DataFrame, images: DataFrame) -> DataFrame:
    """Totals of a crawl's report, one row."""
    n = F.count_if
    a = products.agg(
        F.count(F.lit(1)).alias("products"),
        n(F.coalesce(F.col("image_count").try_cast("long"), F.lit(0)) > 0).alias("products_with_images"),
        n(F.col("dataset_role") == "own_target").alias("own_products"),
        n(F.col("dataset_role") == "competitor").alias("competitor_products"),
    )
    b = images.agg(F.count(F.lit(1)).alias("image_rows"), n(F.col("download_status") == "ok").alias("downloaded_images"))
    return a.crossJoin(b)  # one row each
