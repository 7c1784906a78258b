"""The registered queries of this package: each applies one operator, with its
production parameters, to the whole of its table and derives digests from the
operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe_tree,
    exact_dedup,
    filter_audit,
    jaccard_join,
    knn_kdtree,
    license_scan,
    packing,
    quality_classifier,
    quality_rules,
    secret_scan,
    sharding,
    source_audit,
    token_counts,
)
from .common import table
from .labelled import held_out


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    rules = secret_scan.RULES
    n_base = sum(r.base for r in rules)

    def number(i: int):
        return F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("long")

    base = F.filter("spans", lambda s: s["ord"] < n_base)
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(secret_scan.label(base).cast("binary"), 256).alias("base_sha256"),
        secret_scan.label(F.col("spans")).alias("spans"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_classifier.fit(docs, labels)
    return quality_classifier.score_quality(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction data: tokens, segments and loss-bearing tokens all limit a sequence."""
    packed = packing.pack_conversations(table(spark, sf_dir, "conversations"), max_tokens=2048, max_segments=16, max_loss=768)
    return packed.select("conv_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "n_loss", "sequence_id", "offset")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        "score",
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_tree.encode(table(spark, sf_dir, "documents"), decoded=True)
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_rules.fit(docs, labels)
    return quality_rules.apply_rules(docs, model).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.BUDGET).alias("over_limit"), "fit_chars")


def op10_knn_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = knn_kdtree.top_k(table(spark, sf_dir, "embeddings"))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"))


def op12_filter_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def queries():
    return {
        f.__name__: f
        for f in (
            op1_secret_scan,
            op2_jaccard_join,
            op3_quality_classifier,
            op4_packing,
            packed_conversations,
            op5_license_scan,
            op6_sharding,
            op7_bpe_tree,
            op8_quality_rules,
            op9_token_counts,
            op10_knn_kdtree,
            op11_source_divergence,
            op12_filter_interaction,
            op13_exact_dedup,
        )
    }


def _secret_sql() -> str:
    """DuckDB's form: matches and the pieces between them, summed up from the left."""
    arms = []
    for i, r in enumerate(secret_scan.RULES):
        p = r.pattern.replace("'", "''")
        arms.append(
            f"SELECT rid, {i} AS ord, '{r.kind}' AS kind, {str(r.base).lower()} AS base,"
            f" regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {r.group}) AS g,"
            f" regexp_split_to_array(text, '{p}') AS b, {r.at_least} AS least FROM d"
        )
    union = " UNION ALL ".join(arms)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({union}),
one AS (SELECT rid, ord, kind, base, least, m, g, b, unnest(range(1, len(m) + 1)) AS i FROM raw WHERE len(m) > 0),
spot AS (
  SELECT rid, ord, kind, base, length(g[i]) AS size, least, length(m[i]) AS len,
    list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS start
  FROM one),
span AS (
  SELECT rid, ord, kind, base, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + len AS BIGINT) AS label
  FROM spot WHERE size >= least),
agg AS (
  SELECT rid,
    count(*) FILTER (WHERE ord = 0) AS n_assign, count(*) FILTER (WHERE ord = 1) AS n_access, count(*) FILTER (WHERE ord = 2) AS n_hex,
    coalesce(string_agg(label, ',' ORDER BY start, ord) FILTER (WHERE base), '') AS b,
    string_agg(label, ',' ORDER BY start, ord) AS s
  FROM span GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN agg USING (rid)"""


JACCARD_SQL = r"""
WITH RECURSIVE t AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1),
w AS (
  SELECT row_number() OVER (ORDER BY first_id, text) AS k, first_id, copies,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, text FROM t),
s AS (
  SELECT DISTINCT k, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
p AS (
  SELECT a.k AS a, b.k AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2),
l AS (
  SELECT a, b FROM p JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT k, k FROM w UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
root AS (SELECT a AS k, min(b) AS root FROM reach GROUP BY a),
cls AS (SELECT root, min(first_id) AS class_id FROM root JOIN w USING (k) GROUP BY root),
deg AS (SELECT e.a AS k, sum(w.copies) AS d FROM e JOIN w ON w.k = e.b GROUP BY 1)
SELECT d.doc_id, CASE WHEN len(w.words) = 0 THEN d.doc_id ELSE cls.class_id END AS class_id,
  CAST(CASE WHEN len(w.words) = 0 THEN 0 ELSE w.copies - 1 + coalesce(deg.d, 0) END AS BIGINT) AS n_links
FROM documents d JOIN w ON coalesce(d.text, '') = w.text JOIN root USING (k) JOIN cls USING (root) LEFT JOIN deg ON deg.k = w.k"""

KNN_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
k AS (SELECT lang, term, CAST(sum(c) AS BIGINT) AS c FROM c GROUP BY ALL HAVING sum(docs) >= 10),
v AS (SELECT lang, count(*) AS v, CAST(sum(c) AS BIGINT) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (
  SELECT g.lang, g.source, coalesce(sum(c.c) FILTER (WHERE k.term IS NOT NULL), 0) AS n
  FROM g LEFT JOIN c USING (lang, source) LEFT JOIN k ON k.lang = c.lang AND k.term = c.term GROUP BY ALL),
p AS (
  SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c,
    1 + CAST(1000000000 * CAST(coalesce(c.c, 0) + 2 AS BIGINT) // CAST(n.n + 2 * v.v AS BIGINT) AS BIGINT) AS p,
    1 + CAST(1000000000 * CAST(k.c + 2 AS BIGINT) // CAST(v.n + 2 * v.v AS BIGINT) AS BIGINT) AS q
  FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10"""

FILTERS_SQL = r"""
WITH RECURSIVE l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents),
m AS (
  SELECT t.part, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN t.doc_id > t.least THEN 16 ELSE 0 END AS mask
  FROM t LEFT JOIN l USING (doc_id)),
v AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(letter, bit)),
o(filter_order, used, step) AS (
  SELECT letter, bit, 1 FROM f
  UNION ALL SELECT o.filter_order || f.letter, o.used + f.bit, o.step + 1 FROM o JOIN f ON o.used & f.bit = 0),
s AS (
  SELECT a.filter_order, b.step, b.used, f.bit
  FROM o a JOIN o b ON a.step = 5 AND a.filter_order LIKE b.filter_order || '%' JOIN f ON f.letter = substr(a.filter_order, CAST(b.step AS INTEGER), 1)),
r AS (
  SELECT v.part, s.filter_order, s.step, s.bit,
    sum(CASE WHEN v.mask & s.used = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN v.mask & s.used = s.bit THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN v.mask & s.bit <> 0 AND v.mask & s.used <> s.bit THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN v.mask = s.bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN v.mask & s.used = s.bit THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN v.mask & s.used = s.bit THEN toxic ELSE 0 END) AS toxic_lost
  FROM v CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r"""

DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM t"""


def oracle_sql():
    return {
        "op1_secret_scan": _secret_sql(),
        "op2_jaccard_join": JACCARD_SQL,
        "op10_knn_kdtree": KNN_SQL,
        "op11_source_divergence": DIVERGENCE_SQL,
        "op12_filter_interaction": FILTERS_SQL,
        "op13_exact_dedup": DEDUP_SQL,
    }
