"""Golden cases of text canonicalisation, matching, catalogs and documents."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text as X
from shelfspark.functions import web
from shelfspark.operators import catalog as C
from shelfspark.operators import recognize as R
from shelfspark.sources import docx, readers, reports


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "fn, value, want",
    [
        (X.compact, "АВР-40I", "ABP40I"),
        (X.compact, "SP-3,7 Lite", "SP37LITE"),
        (X.compact_stripped, "ТЕКСТ, 1", "TEKCT1"),
        (X.model_keys, "DY5000LX/DY6500LX", ["DY5000LXDY6500LX", "DY5000LX", "DY6500LX"]),
        (X.model_keys, "SP-3,7 Lite", ["SP37LITE"]),
        (X.model_keys, "A/B1", []),
        (X.model_keys, "GET-20M-2Li", ["GET20M2LI", "ET20M2LI"]),
        (X.article_keys, "73/7/2/6|12, abc1 xyz", ["73726", "ABC1"]),
        (X.article_candidates, "арт 73 / 7-2/6 и 64/1", ["73726"]),
        (X.slugify, "Дрель-шуруповёрт № 5 щ", "drel_shurupovert_5_sch"),
        (X.slugify, "№", "unknown"),
        (X.class_slug, "Ёж 1", "ezh_1"),
        (X.split_pipe, " a | |b11|c", ["a", "b11", "c"]),
        (X.truth_list, "x1; y2|x1", ["x1", "y2"]),
        (X.strip_count, "Дрели (12)", "Дрели"),
        (X.safe_filename, "a b/ж.jpg", "a_b_ж.jpg"),
        (X.file_slug, "  é-№ж ", "e_Noж"),
        (X.sanitize_stem, "***", "image"),
        (X.sku_from_text, "Цена. артикул: 72/14/9 шт", "72/14/9"),
        (X.sku_from_text, "Код: AB-1", "AB-1"),
        (X.article_like, "Артикул: 12", ""),
        (X.normalize, " ａ　b  ", "a b"),
        (X.url_slug, "http://h/a/b?x=1", "b"),
        (X.url_slug, "http://h/", "product"),
    ],
)
def test_text_functions(spark, fn, value, want):
    assert one(spark, value, fn) == want


def test_confusions_are_applied_once(spark):
    assert one(spark, "5P37LITE", X.confusion_variants) == ["5P37LITE", "SP37LITE"]
    assert "ET12345" in one(spark, "T12345", X.confusion_variants)


def test_labels_and_digests(spark):
    row = spark.createDataFrame([("b", None, "", "s1", ["p2", "p1"])], "b string, m string, a string, s string, p array<string>")
    got = row.select(X.model_label("b", "m", "a", "s").alias("l"), X.percent(F.lit(0.1234)).alias("p")).first()
    assert got["l"] == "b — (s1)" and got["p"] == "12.3%"
    import hashlib

    from shelfspark.operators import folder

    paths = [(r, f"p{i}") for i in range(2000) for r in ("b", "c")] + [("b", None), ("d", ""), (None, "x")]
    digests = folder.report_digests(spark.createDataFrame(paths, "root string, path string").repartition(5), "root", "path")
    joined = "".join(sorted(f"p{i}" for i in range(2000)))
    want = {r: "report_" + hashlib.sha256((r + t).encode()).hexdigest()[:12] for r, t in (("b", joined), ("c", joined), ("d", ""))}
    assert {r["root"]: r["report_id"] for r in digests.collect()} == {**want, None: None}


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        (1, "s1", "alpha", "Huterra", True, "Опрыскиватель аккумуляторный", "SP-3,7 Lite", ["73/7/2/6"], []),
        (2, "s2", "beta", "TEKOM", False, "Генератор", "GET-20M-2Li", ["64/1/20"], ["70/1/99"]),
        (3, "s3", "beta", "TEK", False, "Триммер", "DY5000LX/DY6500LX", ["x"], []),
    ]
    cat = spark.createDataFrame(rows, "ord long, sku_id string, brand_id string, brand_name string, is_own_brand boolean, category string, model_name string, article_codes array<string>, aliases array<string>")
    return cat, C.catalog_keys(cat), C.brand_dictionary(cat), C.category_vocabulary(cat)


def test_match_text_decisions(spark, shop):
    texts = {
        1: "73/7/2/26",  # not the article of s1
        2: "код 73/7/2/6",
        3: "Huterra SP37LITE",
        4: "Huterra 5P37LITE",
        5: "ТЕКСТ на коробке",  # holds the letters of a brand
        6: "TEK рядом",
        7: "опрыскиватель",
        8: "",
        9: "шум",
        10: "ET-20M-2Li",
        11: "Huterro генератор",
        12: "70/1/99",
    }
    df = spark.createDataFrame(list(texts.items()), "text_id long, text string")
    got = {r["text_id"]: r for r in R.match_text(df, *shop).collect()}
    assert len(got) == len(texts)
    assert got[1]["status"] != "matched_sku"
    assert (got[2]["sku_id"], got[2]["method"], got[2]["confidence"]) == ("s1", "article_code", 0.78)
    assert (got[3]["sku_id"], got[3]["method"], got[3]["confidence"]) == ("s1", "model_code", 0.9)
    assert (got[4]["status"], got[4]["brand"], got[4]["category"], got[4]["confidence"]) == ("brand_only", "Huterra", "Опрыскиватель аккумуляторный", 0.62)
    assert got[5]["status"] == "unknown"
    assert (got[6]["status"], got[6]["brand"], got[6]["confidence"], got[6]["is_own"]) == ("brand_only", "TEK", 0.6, True)
    assert (got[7]["status"], got[7]["category"], got[7]["confidence"]) == ("category_only", "Опрыскиватель", 0.45)
    assert got[8]["confidence"] == 0.15 and got[9]["confidence"] == 0.3
    assert got[10]["sku_id"] == "s2"
    assert (got[11]["brand"], got[11]["category"]) == ("Huterra", "Генератор")
    assert got[12]["sku_id"] == "s2"


def test_own_brand_text(spark):
    rows = [("a", 1, "mega HUTERRA-5", 0.2), ("b", 1, "TEK", 0.3), ("b", 2, "TEK", 0.5), ("c", 1, "none", 0.9)]
    df = spark.createDataFrame(rows, "box string, ord int, text string, conf double")
    got = {r["box"]: (r["is_own"], r["reason"]) for r in R.own_brand_text(df, ["HUTERRA", "HYTEPPA"], ["TEK"], ["box"]).collect()}
    assert got["b"] == (True, "ocr:TEK") and got["c"] == (False, "")


def test_catalog_files(spark, tmp_path):
    (tmp_path / "c.csv").write_text('sku_id,brand_id,brand_name,is_own_brand,category,model_name,article_codes,barcodes,aliases,reference_images\na,b,B,yes,"x, y",m,1|2||3,,q,\nd,b,-,true,c,m,,,,\n')
    got = readers.catalog(spark, str(tmp_path / "c.csv")).orderBy("ord").collect()
    assert got[0]["article_codes"] == ["1", "2", "3"] and got[0]["is_own_brand"] and got[0]["category"] == "x, y" and len(got) == 2
    assert [r["sku_id"] for r in readers.catalog(spark, str(tmp_path / "c.csv"), recogniser=True).collect()] == ["a"]
    (tmp_path / "c.json").write_text(json.dumps({"items": [{"sku_id": "z", "brand_name": "B", "is_own_brand": True, "article_codes": ["7", "8"]}]}))
    assert readers.catalog(spark, str(tmp_path / "c.json")).first()["article_codes"] == ["7", "8"]
    with pytest.raises(ValueError):
        readers.catalog(spark, "x.xlsx")


def make_docx(path, blocks):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    out = ""
    for b in blocks:
        out += para(b) if isinstance(b, str) else "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(c)}</w:tc>" for c in row) + "</w:tr>" for row in b) + "</w:tbl>"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{out}</w:body></w:document>")
    path.write_bytes(buf.getvalue())


def test_document_catalog(spark, tmp_path):
    head = ["Бренд", "Модель", "Артикул", "Характеристики"]
    make_docx(
        tmp_path / "a.docx",
        ["Catalog", "Дрель-шуруповерт (1)", [head, ["Storm", "DA-18", "72/14/9", "text"], ["Storm", "", "1", ""]], [["Other"], ["x"]], "Пила (2)", [head, ["Storm", "DA-18", "72/14/9", "t2"]]],
    )
    got = C.unique_ids(docx.products(docx.read_body(spark, str(tmp_path)))).orderBy("ord").collect()
    assert [(r["category"], r["article_codes"], r["is_own_brand"]) for r in got] == [("Дрель-шуруповерт", ["72/14/9"], True), ("Пила", ["72/14/9"], True)]
    assert got[0]["sku_id"] == "STORM_72_14_9_DA_18" and got[1]["sku_id"] == "STORM_72_14_9_DA_18_2"


def test_pages(spark):
    html = """<html><head><title>T</title><script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":["Product"],"name":"Saw 5","sku":"S5","brand":{"name":"Storm"},"image":"/i.jpg"}]}</script></head>
    <body><ul><li class="breadcrumb">Home</li><li class="breadcrumb">Saws</li></ul><h1>Head</h1><img data-src="a.png" srcset="b.png 1x, c.png 2x"></body></html>"""
    got = web.page_fields("http://h/p/", html)
    assert got == {"name": "Saw 5", "sku": "S5", "brand": "Storm", "category": "Saws", "images": ["http://h/i.jpg", "http://h/p/a.png", "http://h/p/b.png", "http://h/p/c.png"]}
    assert one(spark, html, web.heading) == "Head" and one(spark, "a.jpg 1x, b.jpg", web.srcset) == ["a.jpg", "b.jpg"]
    assert one(spark, "# N\n![i](u.png) [l](v)", web.markdown_fields)["links"] == ["v"]
    hosts = {"shop.test": (3, 4, -1)}
    url = "http://shop.test/upload/resize_cache/iblock/ab/cd/100_100/x.jpg"
    assert one(spark, url, lambda c: web.normalize_image_url(c, hosts)) == "http://shop.test/upload/iblock/ab/cd/x.jpg"


def test_job_and_report_texts(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 5)], "value string, n long")
    totals = spark.createDataFrame([(3, 4)], "unique long, seen long")
    text = [r["line"] for r in reports.job_text(totals, ["unique", "seen"], counts).orderBy("section", "place").collect()]
    assert text == ["# Report", "", "## Totals", "", "- unique: 3", "- seen: 4", "", "a: 5", "b: 2"]
    rows = spark.createDataFrame([("x", 1), ("y", None)], "k string, v long")

    def lines(df):
        return [r["line"] for r in df.orderBy("place").collect()]

    assert lines(reports.markdown_table(rows, {"k": "K", "v": "V"}, [F.col("k")], "Title")) == ["## Title", "", "| K | V |", "|---|---|", "| x | 1 |", "| y | - |"]
    assert lines(reports.markdown_table(rows.limit(0), {"k": "K"}, [F.col("k")], "T")) == ["## T", "", "None."]


def test_report_files_keep_the_order_of_lines(spark, tmp_path):
    from shelfspark.sources import reports

    rows = spark.range(5000).select(F.format_string("%05d", F.col("id")).alias("k")).repartition(7)
    text = reports.document("R", [reports.markdown_table(rows, {"k": "K"}, [-F.col("k").cast("int")], "T")])
    reports.write_document(text, str(tmp_path / "r"))
    got = [x for f in sorted((tmp_path / "r").glob("part-*")) for x in f.read_text().splitlines()]
    assert got == ["# R", "", "## T", "", "| K |", "|---|", *[f"| {i:05d} |" for i in reversed(range(5000))]]
