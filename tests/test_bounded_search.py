"""Reference search and repeated sightings with bounds: equal to all pairs, with far fewer scores."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfspark.functions import vectors as V
from shelfspark.operators import vectorsearch


def clustered(n, groups, dims=8, seed=1, spread=0.02):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, dims))
    v = centre[np.arange(n) % groups] / np.linalg.norm(centre, axis=1)[np.arange(n) % groups][:, None]
    return [x.tolist() for x in v + rng.normal(size=v.shape) * spread]


def nearest(df, most):
    n = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return Counter(map(str, df.withColumn("n", n).where(F.col("n") <= most).select("query_id", "row_id", "product_key", "score").collect()))


@pytest.mark.parametrize("odd", [False, True])
def test_search_scores_few_and_finds_all(spark, monkeypatch, odd):
    vectors = clustered(2000, 25)
    vectors[100:400] = [vectors[100]] * 300  # a large group of equal vectors
    if odd:
        vectors[400:407] = [None, [1.0, None] + [0.0] * 6, [1.0, 2.0], [], [float("nan")] + [1.0] * 7, [0.0] * 8, [1e-12] * 8]
    index = spark.createDataFrame([(i, v, f"p{i % 7}") for i, v in enumerate(vectors)], "row_id long, v array<double>, product_key string")
    q = index.where("row_id % 20 = 0 OR row_id BETWEEN 400 AND 406").select(F.col("row_id").alias("query_id"), F.col("v").alias("q"))
    scored = q.select("query_id", V.unit("q").alias("q")).crossJoin(index.withColumn("v", V.unit("v"))).withColumn("score", V.dot("q", "v"))
    want = nearest(scored, 12)
    monkeypatch.setattr(vectorsearch, "SHARD_ROWS", 90)
    monkeypatch.setattr(vectorsearch, "CLUSTER_ROWS", 40)
    real, met = vectorsearch._scores, []

    def counted(rows, asked, shards, most):
        met.append(asked.join(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "shard").agg(F.sum("n")).first()[0] or 0)
        return real(rows, asked, shards, most)

    monkeypatch.setattr(vectorsearch, "_scores", counted)
    assert nearest(vectorsearch._nearest(q, index, 12), 12) == want
    assert len(met) == 2
    if not odd:
        assert sum(met) < q.count() * len(vectors) / 4


def test_search_of_few_or_no_rows(spark, monkeypatch):
    monkeypatch.setattr(vectorsearch, "SHARD_ROWS", 4)
    monkeypatch.setattr(vectorsearch, "CLUSTER_ROWS", 2)
    index = spark.createDataFrame([(i, [1.0, float(i)], "p") for i in range(9)], "row_id long, v array<double>, product_key string")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "query_id long, q array<double>")
    got = vectorsearch.reference_search(q, index, k=1, prefetch=50).collect()
    assert {(r["query_id"], r["row_id"]) for r in got} == {(1, 8), (2, 0)}
    assert vectorsearch.reference_search(q, index.where("false")).collect() == []
    assert vectorsearch.reference_search(q.where("false"), index).collect() == []
    nulls = index.withColumn("v", F.lit(None).cast("array<double>"))
    assert vectorsearch.reference_search(q, nulls, k=1).count() == 2


def plain_sum(values):
    s = 0.0
    for x in values:  # one after another: sum() compensates
        s += x
    return s


def plain_edges(rows, similarity, min_gap):
    out = Counter()
    unit = [None if v is None or None in v else [x / max(math.sqrt(plain_sum(y * y for y in v)), 1e-8) for x in v] for *_, v in rows]
    for i, (k, a, f1, l1, _) in enumerate(rows):
        for j, (m, b, f2, l2, _) in enumerate(rows):
            if k is None or k != m or a >= b or unit[i] is None or unit[j] is None or len(unit[i]) != len(unit[j]) or None in (f1, f2, l1, l2):
                continue
            gap = f2 - l1 if l1 < f2 else f1 - l2 if l2 < f1 else None
            sim = plain_sum(x * y for x, y in zip(unit[i], unit[j]))
            if gap is not None and gap >= min_gap and not sim < similarity:
                out[k, a, b, sim, gap] += 1
    return out


@pytest.mark.parametrize("similarity", [0.96, 0.2])
def test_repass_in_blocks_equals_all_pairs(spark, monkeypatch, similarity):
    vectors = clustered(420, 30, dims=6, seed=3, spread=0.05)
    vectors[0:60] = [vectors[0]] * 60
    if similarity < 0.5:
        vectors[60:66] = [None, [1.0, None], [1.0, 2.0], [], [float("nan")] + [1.0] * 5, [0.0] * 6]
    rows = [("big" if i % 6 else f"small{i % 4}", i, (i * 37) % 500, (i * 37) % 500 + 5, v) for i, v in enumerate(vectors)]
    rows += [(None, 900, 0, 1, vectors[1]), ("big", 901, None, 4, vectors[1])]
    t = spark.createDataFrame(rows, "video string, ord long, first long, last long, v array<double>").repartition(3)
    monkeypatch.setattr(vectorsearch, "BLOCK_TRACKS", 24)
    real, tables = vectorsearch.written, []
    monkeypatch.setattr(vectorsearch, "written", lambda df: tables.append(real(df)) or tables[-1])
    got = Counter(tuple(r) for r in vectorsearch.repass_edges(t, "video", similarity, 12).collect())
    want = plain_edges(rows, similarity, 12)
    got, want = ({repr(k): n for k, n in x.items()} for x in (got, want))
    assert (sorted(got.items() - want.items())[:5], sorted(want.items() - got.items())[:5]) == ([], []) and len(want) > 50
    heads, met = next(x for x in tables if "radius" in x.columns), next(x for x in tables if "b_block" in x.columns)
    if similarity > 0.5:  # far fewer blocks meet than all
        n = heads.where("k = 'big'").count()
        assert n > 10 and met.count() < n * (n - 1) / 2 / 2


def test_repass_keeps_the_kind_of_a_video(spark, monkeypatch):
    monkeypatch.setattr(vectorsearch, "BLOCK_TRACKS", 8)
    vectors = clustered(60, 4, dims=4)
    rows = [(i % 2, i, (i * 37) % 500, (i * 37) % 500 + 5, v) for i, v in enumerate(vectors)]
    t = spark.createDataFrame(rows, "video int, ord int, first int, last int, v array<float>")
    got = vectorsearch.repass_edges(t, "video", 0.9, 12)
    assert [k for _, k in got.dtypes[:3]] == ["int"] * 3 and got.count() > 100


def test_repass_of_nothing(spark):
    t = spark.createDataFrame([], "video string, ord long, first long, last long, v array<double>")
    assert vectorsearch.repass_edges(t, "video").collect() == []
