"""Writers and report texts; documents are assembled from rows, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.numbering import numbered


#: Places of the lines above a section's rows.
BLANK, TITLE, GAP, HEAD, RULE = -5, -4, -3, -2, -1


def _lines(spark, lines: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame(lines, "place long, line string")


def markdown_table(rows: DataFrame, columns: dict[str, str], order: list, title: str, empty: str = "None.") -> DataFrame:
    """A titled table of a report, of ``columns`` (name to header), as lines
    (``place``, ``line``); rows stay rows, numbered in ``order``."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]), F.lit(" |"))
    keys = [f"o{i}" for i in range(len(order))]
    sorted_ = numbered(rows.select(*[o.alias(k) for o, k in zip(order, keys)], line.alias("line")), [*keys, "line"], "place")
    head = _lines(rows.sparkSession, [(HEAD, "| " + " | ".join(columns.values()) + " |"), (RULE, "|" + "---|" * len(columns))])
    some = sorted_.limit(1).select(F.lit(1).alias("one"))
    heads = head.join(F.broadcast(some), how="left_semi", on=F.lit(True))
    none = _lines(rows.sparkSession, [(0, empty)]).join(F.broadcast(some), how="left_anti", on=F.lit(True))
    return _lines(rows.sparkSession, [(TITLE, f"## {title}"), (GAP, "")]).unionByName(heads).unionByName(none).unionByName(sorted_.select("place", "line"))


def totals_lines(totals: DataFrame, names: list[str], title: str) -> DataFrame:
    """Counters (of one row) as lines of a list."""
    lines = F.array(*[F.concat(F.lit(f"- {n}: "), F.col(n).cast("string")) for n in names])
    listed = totals.select(F.posexplode(lines).alias("place", "line")).select((F.col("place") + 1).cast("long").alias("place"), "line")
    return _lines(totals.sparkSession, [(TITLE, f"## {title}"), (GAP, "")]).unionByName(listed)


def document(title: str, sections: list[DataFrame]) -> DataFrame:
    """A report as lines: ``section``, ``place`` in it and ``line``."""
    spark = sections[0].sparkSession
    out = spark.createDataFrame([(0, TITLE, f"# {title}")], "section int, place long, line string")
    for i, s in enumerate(sections, 1):
        blank = _lines(spark, [(BLANK, "")])
        out = out.unionByName(blank.unionByName(s).select(F.lit(i).alias("section"), "place", "line"))
    return out


def write_document(lines: DataFrame, path: str) -> None:
    """A report's lines as text files; the files by name, and lines within, are in order."""
    lines.repartitionByRange("section", "place").sortWithinPartitions("section", "place").select("line").write.mode("overwrite").text(path)


def with_total(rows: DataFrame, key: str, sums: list[str], label: str = "TOTAL") -> DataFrame:
    """Rows by key and one more with the sums, marked to sort last."""
    parts = rows.select(F.col(key).cast("string").alias(key), *sums, F.lit(0).alias("is_total"))
    total = rows.agg(*[F.sum(c).alias(c) for c in sums]).select(F.lit(label).alias(key), *sums, F.lit(1).alias("is_total"))
    return parts.unionByName(total)


def megabytes(size) -> Column:
    # halves go to the even digit; the format alone would round them up
    mb = F.bround(X.col(size) / (1024 * 1024), 1)
    return F.when(mb.isNotNull(), F.format_string("%.1f", mb))


def dimensions(width, height) -> Column:
    return F.coalesce(F.concat(X.col(width).cast("string"), F.lit("x"), X.col(height).cast("string")), F.lit("-"))


def job_text(totals: DataFrame, names: list[str], counts: DataFrame) -> DataFrame:
    """A client's text as lines: counters, then ``name: n`` by descending count."""
    line = F.concat("value", F.lit(": "), F.col("n").cast("string")).alias("line")
    listed = numbered(counts.select((-F.col("n")).alias("n"), "value", line), ["n", "value"], "place").select("place", "line")
    return document("Report", [totals_lines(totals, names, "Totals"), listed])


def label_tasks(boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """Annotation tasks as JSON, one for each image: boxes in percent, mean score."""
    value = F.struct(
        *[(F.col(c) * 100).alias(n) for c, n in (("x", "x"), ("y", "y"), ("w", "width"), ("h", "height"))], F.array("label").alias("rectanglelabels")
    )
    result = F.struct(F.lit("rectanglelabels").alias("type"), value.alias("value"), F.col("conf").alias("score"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", result.alias("r")))), lambda s: s["r"])
    return boxes.groupBy(key).agg(
        F.to_json(F.struct(F.struct(F.col(key).alias("image_id")).alias("data"), F.array(F.struct(ordered.alias("result"), F.avg("conf").alias("score"))).alias("predictions"))).alias("task")
    )


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_both(df: DataFrame, path: str) -> None:
    """As CSV and as JSON lines."""
    write_csv(df, f"{path}/csv")
    write_json(df, f"{path}/jsonl")


def write_index(df: DataFrame, path: str) -> None:
    """A reference index, vectors without direction left out, by brand."""
    from ..functions.vectors import norm

    df.where(norm("embedding") > 0).write.mode("overwrite").partitionBy("brand_id").parquet(path)


def write_versioned(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("version").parquet(path)


def track_manifests(tracks: DataFrame, key: str = "video") -> DataFrame:
    """One JSON document ``doc`` for each video: its tracks in order of their ids."""
    fields = "track_id crop crop_candidates n_frames peak_conf best_frame first_frame last_frame box".split()
    rows = F.sort_array(F.collect_list(F.struct(*[f for f in fields if f in tracks.columns])))
    return tracks.groupBy(key).agg(rows.alias("tracks")).select(key, F.to_json(F.struct(key, F.size("tracks").alias("kept_tracks"), "tracks")).alias("doc"))


def data_yaml(classes: DataFrame, root: str = ".") -> DataFrame:
    """A dataset's data.yaml as lines (``section``, ``place``, ``line``): ``classes`` are ``place``, from 0, and ``name``."""
    spark = classes.sparkSession
    head = [(0, i, x) for i, x in enumerate([f"path: {root}", "train: images/train", "val: images/val", "names:"])]
    named = classes.select(F.lit(1).alias("section"), F.col("place").cast("long").alias("place"), F.concat(F.lit("  "), F.col("place").cast("string"), F.lit(": "), "name").alias("line"))
    return spark.createDataFrame(head, "section int, place long, line string").unionByName(named)


def write_documents(df: DataFrame, doc: str, path: str) -> None:
    """One file for each row's text."""
    df.select(F.col(doc).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def in_time_order(spark, path: str) -> None:
    """Give the files of a folder, in the order of their names, times a second apart: streams read files by time."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(f.getPath().toString() for f in fs.listStatus(at) if f.getPath().getName().startswith("part-"))
    first = min((f.getModificationTime() for f in fs.listStatus(at)), default=0) - 1000 * len(names)
    for i, name in enumerate(names):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(name), first + 1000 * i, -1)
