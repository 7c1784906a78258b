"""Queries over small tables of rows that once came out other than their SQL says."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E


@pytest.fixture
def differs(spark, tmp_path):
    """Rows that only the SQL of a query gives, and rows that only the query gives, over tables told in SQL."""

    def run(name, **tables):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t, sql in tables.items():
            con.execute(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet'")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        want = con.execute(f"SELECT * FROM ({E.oracle_sql()[name]})")
        columns = [c[0] for c in want.description]
        want = want.fetchall()
        got = [tuple(r) for r in E.queries()[name](spark, str(tmp_path)).select(*columns).collect()]
        assert want
        want, got = Counter(want), Counter(got)
        return list(want - got), list(got - want)

    return run


@pytest.mark.parametrize("name", ["category_match", "token_brand_match"])
def test_words_end_at_letters_without_one_capital(differs, name):
    bench = "SELECT 1 AS item_id, 'einßsein schein Straßenbahn \ufb01nden \u017fonne' AS text"
    docs = "SELECT unnest([1, 2, 3]) AS doc_id, unnest(['Einßsein, Schein', 'straßenbahn enbahn', NULL]) AS text"
    assert differs(name, benchmark=bench, documents=docs) == ([], [])


@pytest.mark.parametrize("name", ["token_brand_match", "category_match"])
def test_ligatures_in_documents_have_no_capitals(differs, name):
    bench = "SELECT 1 AS item_id, 'figma lambda alpha lambfia alphaj' AS text"
    docs = "SELECT unnest([1, 2, 3, 4, 5]) AS doc_id, unnest(['\ufb01gma', 'lamb\ufb01a Lambda', 'alpha\u01f0', 'alpha\u1e96 \n figma', '\u1fb3figma alpha\u00df']) AS text"
    assert differs(name, benchmark=bench, documents=docs) == ([], [])


def test_canon_of_letters_with_several_capitals(differs):
    docs = "SELECT 1 AS doc_id, 'Stra\u00dfe \ufb01\ufb03 \u0149 \u1fb3\u1f80\u03b1 \n\u1e96x' AS text UNION ALL SELECT 2, NULL UNION ALL SELECT 3, ''"
    assert differs("canon_compact", documents=docs) == ([], [])


def test_scores_that_look_like_probabilities_are_raised_too(differs):
    assert differs("class_probabilities", embeddings="SELECT unnest([1, 2]) AS vec_id, unnest([[0.25, 0.25, 0.3, 0.2, 7], [3, -1, 0, 2, 7]])::FLOAT[] AS embedding") == ([], [])


def test_names_beyond_five_digits(differs):
    assert differs("export_names", documents="SELECT range * 5 + CASE WHEN range < 3 THEN 1 ELSE 0 END AS doc_id, 'en' AS lang FROM range(100004)") == ([], [])


EVENTS = """SELECT unnest([1, 2, 3, 4, 5, 6, 7, NULL, 9, 10, 11, 12]) AS event_id,
  TIMESTAMP '2024-03-10 00:00:00' + to_minutes(unnest([0, 5, 5, 9, 0, 1, 2, 20, 30, NULL, 400, 401])) AS ts, unnest([1, 1, 1, 1, NULL, NULL, 2, 2, 2, 2, 3, 3]) AS user_id,
  unnest(['view', 'click', 'view', 'purchase', 'view', 'purchase', 'view', 'view', 'error', 'purchase', 'view', 'error']) AS event_type,
  unnest([1.0, 7.5, 'NaN'::DOUBLE, NULL, 2, 3, NULL, 4, 5, 6, 1, 1])::DOUBLE AS value, '{}' AS props"""


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("name", ["feedback_replay", "stream_feedback"])
def test_feedback_of_odd_events_in_any_zone(spark, differs, name, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert differs(name, events=EVENTS) == ([], [])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


OLD_EVENTS = """SELECT range + 1 AS event_id, (['2024-03-10 00:00:00', '1969-12-31 23:00:00', '1970-01-01 00:00:00', '1969-12-31 23:59:59.999999', '1921-05-05 00:00:00'])[greatest(range // 2 - 2, 1)]::TIMESTAMP AS ts,
  CASE WHEN range < 4 THEN 0 WHEN range < 8 THEN 1 ELSE range // 2 END AS user_id, (['view', 'view', 'view', 'purchase', 'view', 'view', 'view', 'purchase'])[range + 1] AS new_type,
  coalesce(new_type, CASE range % 2 WHEN 0 THEN 'view' ELSE 'error' END) AS event_type, coalesce(([1.005, 1.0, 1.01, 1, 'inf'::DOUBLE, 'NaN'::DOUBLE, 1e307])[range + 1], 1)::DOUBLE AS value, '{}' AS props FROM range(16)"""


@pytest.mark.parametrize("name", ["feedback_replay", "stream_feedback"])
def test_feedback_of_old_events_and_halves_of_a_cent(differs, name):
    assert differs(name, events=OLD_EVENTS) == ([], [])


LARGE_IDS = """SELECT CASE WHEN range IN (3, 8) THEN NULL ELSE 9007199254740993 + 2 * range END AS event_id, TIMESTAMP '2024-03-10 00:00:00' + to_minutes(range // 3) AS ts, 1 AS user_id,
  CASE WHEN range IN (2, 5, 9, 14) THEN 'error' ELSE 'view' END AS event_type, (CASE WHEN range = 3 THEN 9 ELSE range % 4 END)::DOUBLE AS value, '{}' AS props FROM range(15)"""


@pytest.mark.parametrize("name", ["feedback_replay", "stream_feedback"])
def test_feedback_of_ids_beyond_a_double_beside_absent_ones(differs, name):
    assert differs(name, events=LARGE_IDS) == ([], [])


def test_halves_of_a_digit_and_absent_sizes(differs):
    events = "SELECT unnest([262144, 786432, 7, -7, -5, 10, 11, NULL]::BIGINT[]) AS event_id, unnest([1, 2, 3, 4, NULL, NULL, NULL, 5]) AS user_id"
    assert differs("media_columns", events=events) == ([], [])


def test_references_without_an_end_stay(differs):
    page = "'<title>t</title><h1>A &amp;amp; B&lt;b&gt; &quot;q&#39; &nbsp;x &amp</h1><script type=\"application/ld+json\">{\"@type\": \"Product\", \"brand\": \"S & T\"}</script>'"
    assert differs("page_products", pages=f"SELECT 1 AS page_id, 'http://h/p' AS url, {page} AS html UNION ALL SELECT 2, 'http://h/q', '<h1>C &amp</h1>'") == ([], [])


def test_keys_inside_never_broadcasts(spark):
    """Whatever the files of keys let expect: rows made of them went through the driver."""
    from shelfspark.operators import recognize as R

    keys = spark.createDataFrame([("a", 2, "model", k, len(k)) for k in ("AB12", "XYZ12345", "GET123456789M12LITE", "T123456M")] + [("b", 1, "model", "AB12", 4)], "sku_id string, ord long, kind string, key string, key_len int")
    hay = spark.createDataFrame([(1, "QAB12Q"), (2, "GET123456789M12LITEXYZ12345"), (3, "A1"), (4, "GET123456789M12LIT"), (5, None)], "text_id long, hay string")
    found = R.keys_inside(hay, keys)
    assert sorted((r["text_id"], r["key"], r["sku_id"]) for r in found.collect()) == [(1, "AB12", "b"), (2, "GET123456789M12LITE", "a"), (2, "XYZ12345", "a")]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["match_text_exact", "match_text"])
def test_catalog_is_dealt_out_before_its_keys_are_made(spark, small, monkeypatch, name):
    """Parts lie in one small file, whose single task would make all keys."""
    from shelfspark.operators import catalog

    parts, real = [], catalog.catalog_keys
    monkeypatch.setattr(catalog, "catalog_keys", lambda c: (parts.append(c.rdd.getNumPartitions()), real(c))[1])
    assert E.queries()[name](spark, small).count() > 0
    assert parts == [4]
