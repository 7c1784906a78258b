"""Readers: every one gives a DataFrame, with order columns where order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.geometry import parse_label
from ..operators import folder
from ..operators.catalog import parse_catalog

CATALOG_COLUMNS = (
    "sku_id brand_id brand_name is_own_brand category model_name article_codes barcodes aliases reference_images".split()
)


def media_files(spark: SparkSession, roots: str | list[str], exclude_first: tuple[str, ...] = ("var",), exclude_any: tuple[str, ...] = ()) -> DataFrame:
    """Images and videos below the roots: ``path`` relative to its root, ``size``,
    ``modified``.  Only the listing is read, never the content."""
    out = None
    for root in [roots] if isinstance(roots, str) else roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        bare = F.regexp_replace("path", r"^[a-z]+:/+", "/")
        rel = files.select(
            X.relative_path(root, bare).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.lit(root).alias("root")
        )
        out = rel if out is None else out.unionByName(rel)
    p = folder.parts()
    keep = (folder.media_kind() != "unsupported") & ~F.get(p, F.lit(0)).isin(*exclude_first)
    for name in exclude_any:
        keep = keep & ~F.array_contains(p, name)
    return out.where(keep).distinct()


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, rows numbered by ``ord`` as they stand in the file."""
    rows = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return rows.withColumn("ord", F.monotonically_increasing_id())


def catalog(spark: SparkSession, path: str, recogniser: bool = False) -> DataFrame:
    """A catalog file: CSV, or JSON as a list or an object with ``items``."""
    if path.endswith(".csv"):
        rows = csv_rows(spark, path)
    elif path.endswith(".json"):
        rows = spark.read.json(path, multiLine=True)
        if "items" in rows.columns:
            rows = rows.select(F.explode("items").alias("i")).select("i.*")
        lists = [c for c, t in rows.dtypes if t.startswith("array")]
        rows = rows.withColumns({c: F.array_join(c, "|") for c in lists}).withColumn("ord", F.monotonically_increasing_id())
    else:
        raise ValueError(f"a catalog is a .csv or .json file, not {path}")
    for c in CATALOG_COLUMNS:
        rows = rows.withColumn(c, F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string"))
    return parse_catalog(rows.select("ord", *CATALOG_COLUMNS), recogniser)


def manifest(spark: SparkSession, path: str, key: str = "image_id") -> DataFrame:
    """A manifest, the last row of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ord")))
    return csv_rows(spark, path).withColumn("_n", n).where("_n = 1").drop("_n")


def truth_skus(spark: SparkSession, path: str) -> DataFrame:
    """(video, sku): videos without any listed item have one row with a null one."""
    rows = csv_rows(spark, path)
    name = "expected_sku_ids" if "expected_sku_ids" in rows.columns else "expected_skus"
    named = rows.where(F.trim(X.or_empty("video")) != "").select(base_name("video").alias("video"), X.truth_list(name).alias("s"))
    return named.select("video", F.explode_outer("s").alias("sku"))


def truth_counts(spark: SparkSession, path: str) -> DataFrame:
    rows = csv_rows(spark, path).where(F.trim(X.or_empty("video")) != "")
    return rows.select(base_name("video").alias("video"), F.col("true_objects").try_cast("long").alias("true_objects"))


def base_name(path):
    return F.element_at(F.split(F.trim(X.col(path)), r"[/\\]"), -1)


def reports(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Report files by video name (the file's own where it has none), the last file of each."""
    rows = spark.read.schema(schema).json(pattern, multiLine=True).withColumn("_file", F.col("_metadata.file_name"))
    stem = F.regexp_replace("_file", r"^audit_|\.json$", "")
    named = rows.withColumn("video", F.coalesce(X.falsy_null(base_name(X.or_empty("video"))), stem))
    n = F.row_number().over(Window.partitionBy("video").orderBy(F.desc("_file")))
    return named.withColumn("_n", n).where("_n = 1").drop("_n")


def yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, line_no, cls, x1..y2) of label files; files without lines give no rows."""
    lines = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("image_id"), F.posexplode(F.split("value", "\n")).alias("line_no", "line")
    )
    return lines.withColumn("b", parse_label("line")).where("b is not null").select("image_id", "line_no", "b.*")


def coco(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, file_name, category_id) of a COCO file."""
    data = spark.read.json(path, multiLine=True)
    images = data.select(F.explode("images").alias("i")).select(F.col("i.id").alias("image_id"), "i.file_name")
    marks = data.select(F.explode("annotations").alias("a")).select("a.image_id", "a.category_id")
    return images.join(marks, "image_id")


def label_studio(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, ord, label, x, y, width, height in percent) of an export."""
    tasks = spark.read.json(path, multiLine=True)
    results = tasks.select(F.col("data.image_id").alias("image_id"), F.explode("annotations").alias("a")).select("image_id", F.posexplode("a.result").alias("ord", "r"))
    v = "r.value"
    return results.select("image_id", "ord", F.get(F.col(f"{v}.rectanglelabels"), F.lit(0)).alias("label"), *[f"{v}.{c}" for c in ("x", "y", "width", "height")])


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """Manual entries by image: a JSON object of lists."""
    kind = "map<string,array<struct<class:string,box:array<double>,reason:string,confidence:double>>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return text.select(F.explode("m").alias("image_id", "entries")).select("image_id", F.posexplode("entries").alias("ord", "e")).select("image_id", "ord", "e.*")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(url, file, ord) of sitemap files, each URL once, at its first place: by file, then in it."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_xml("value", "url array<struct<loc:string>>").alias("x"))
    rows = files.select("file", F.posexplode("x.url").alias("ord", "u")).select(F.trim("u.loc").alias("url"), "file", "ord")
    return rows.where("url <> ''").groupBy("url").agg(F.min(F.struct("file", "ord")).alias("o")).select("url", "o.file", "o.ord")


def sitemap_index(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(path)
    return rows.select(F.trim("loc").alias("url")).distinct()


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pixels (BGR) with their path; broken files have no size."""
    return spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")


def jobs(events: DataFrame) -> DataFrame:
    """The latest state of each job from its events, the newest jobs first."""
    last = F.max_by(F.struct(*[c for c in events.columns if c != "job_id"]), "ts")
    return events.groupBy("job_id").agg(last.alias("e")).select("job_id", "e.*").orderBy(F.desc("ts"), "job_id")


def existing_only(rows: DataFrame, listing: DataFrame, key: str = "path", limit: int | None = None, order: str = "ord") -> DataFrame:
    """Metadata rows whose file is listed."""
    kept = rows.join(listing.select(key).distinct(), key, "left_semi")
    return kept.orderBy(order).limit(limit) if limit else kept


def probe_rows(probes: DataFrame, raw: str = "probe") -> DataFrame:
    """Width, height and duration from a probe's JSON; the stream's duration before the container's."""
    kind = "streams array<struct<codec_type:string,width:string,height:string,duration:string>>, format struct<duration:string>"
    p = probes.withColumn("_p", F.from_json(raw, kind))
    s = F.get(F.filter("_p.streams", lambda x: x["codec_type"] == "video"), F.lit(0))
    return p.select(
        *[c for c in probes.columns if c != raw],
        s["width"].try_cast("int").alias("width"),
        s["height"].try_cast("int").alias("height"),
        F.coalesce(s["duration"].try_cast("double"), F.col("_p.format.duration").try_cast("double")).alias("duration_seconds"),
    )


TRACKS = (
    "video string, raw_tracks long, kept_tracks long, tracks array<struct<track_id:long,crop:string,"
    "crop_candidates:array<struct<crop:string,score:double,frame:long,box:array<long>>>,n_frames:long,peak_conf:double,best_frame:long,"
    "first_frame:long,last_frame:long,box:array<long>>>"
)


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """Tracks of track manifests, one row each, with their video."""
    return spark.read.schema(TRACKS).json(path, multiLine=True).select("video", F.explode("tracks").alias("t")).select("video", "t.*")


def reference_index(spark: SparkSession, path: str) -> DataFrame:
    """A written index: vectors of unit length; all must have one dimension."""
    from ..functions.vectors import unit

    rows = spark.read.parquet(path)
    sizes = rows.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"{path}: vectors of {sizes[0]} and of {sizes[1]} dimensions")
    return rows.withColumn("embedding", unit("embedding"))


def data_yaml(spark: SparkSession, path: str, at: str) -> DataFrame:
    """(class_id, name, root) of a data.yaml in folder ``at``: the root is its ``path``, below ``at`` unless absolute."""
    lines = spark.read.text(path)
    given = F.trim(F.regexp_replace("value", r"^path:|['\"]", ""))
    below = F.concat(F.lit(at.rstrip("/") + "/"), given)
    root = F.when(given.isin("", "."), at).when(given.startswith("/") | given.contains("://"), given).otherwise(below)
    named = lines.where(F.col("value").startswith("path:")).agg(F.coalesce(F.first(root), F.lit(at)).alias("root"))  # one row
    entry = F.col("value").rlike(r"^  \d+: ")
    classes = lines.where(entry).select(F.regexp_extract("value", r"^  (\d+): ", 1).cast("long").alias("class_id"), F.regexp_extract("value", r"^  \d+: (.*)$", 1).alias("name"))
    return classes.crossJoin(F.broadcast(named))
