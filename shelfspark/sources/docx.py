"""Catalog documents: a Python data source over the XML inside a .docx file.

``spark.read.format("docx_catalog").load(path)`` after :func:`register` gives the
body in order (``path``, ``ord``, ``kind`` paragraph or row, ``text``, ``cells``);
:func:`products` turns it into catalog rows.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: The header of a product table.
HEADER = ["бренд", "модель", "артикул", "характеристики"]
BODY = "path string, ord int, kind string, table int, text string, cells array<string>"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{NS}t"))


def body_rows(path: str, content: bytes):
    """Paragraphs and table rows of a document in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{NS}body")
    n = table = 0
    for node in body:
        if node.tag == f"{NS}p":
            yield path, n, "paragraph", None, _text(node), None
            n += 1
        elif node.tag == f"{NS}tbl":
            for row in node.iter(f"{NS}tr"):
                yield path, n, "row", table, None, [_text(c) for c in row.findall(f"{NS}tc")]
                n += 1
            table += 1


def read_body(spark: SparkSession, path: str) -> DataFrame:
    """Bodies of all documents below ``path``, through Spark's own file reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.docx").load(path).select("path", "content")

    def run(it):
        import pandas as pd

        for batch in it:
            rows = [r for p, c in zip(batch["path"], batch["content"]) for r in body_rows(p, c)]
            yield pd.DataFrame(rows, columns=["path", "ord", "kind", "table", "text", "cells"])

    return files.mapInPandas(run, BODY)


def products(body: DataFrame, is_own: bool = True, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Rows of product tables; a heading that ends in a count in parentheses is the
    category of the tables after it."""
    heading = X.clean("text")
    names = (F.col("kind") == "paragraph") & heading.rlike(r"\(\d+\)$") & ~F.lower(X.strip_count(heading)).isin("", *excluded)
    w = Window.partitionBy("path").orderBy("ord")
    cells = F.transform("cells", X.clean)
    is_header = F.transform(cells, F.lower) == F.array(*map(F.lit, HEADER))
    rows = (
        body.withColumn("category", F.last(F.when(names, X.strip_count(heading)), ignorenulls=True).over(w))
        .where("kind = 'row'")
        .withColumn("c", cells)
        .withColumn("_first", F.row_number().over(Window.partitionBy("path", "table").orderBy("ord")) == 1)
        .withColumn("_good", F.max(F.when(F.col("_first"), is_header)).over(Window.partitionBy("path", "table")))
        .where("_good AND NOT _first AND size(c) = 4 AND c[0] <> '' AND c[1] <> '' AND c[2] <> ''")
    )
    brand, model, article, more = (F.get("c", F.lit(i)) for i in range(4))
    return rows.select(
        "path",
        "ord",
        X.sku_id(brand, article, model).alias("sku_id"),
        X.slugify(brand).alias("brand_id"),
        brand.alias("brand_name"),
        F.lit(is_own).alias("is_own_brand"),
        "category",
        model.alias("model_name"),
        F.array(article).alias("article_codes"),
        F.array().cast("array<string>").alias("barcodes"),
        X.aliases(brand, model, article).alias("aliases"),
        F.array().cast("array<string>").alias("reference_images"),
        more.alias("characteristics"),
    )
