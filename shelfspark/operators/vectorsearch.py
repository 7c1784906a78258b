"""Reference search and re-appearance edges on embedding arrays."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.vectors import dot, unit
from .written import written

#: Rows of the index that one task holds, and queries that meet them at once.
SHARD_ROWS = 32768
QUERY_ROWS = 128
#: More than a matrix product of unit vectors can differ from the sum in order, and than an angle can be wrong.
SLACK, ANGLE_SLACK = 1e-9, 1e-6
#: Rows for each sampled centre, and centres at most.
CLUSTER_ROWS, CLUSTERS = 4096, 1024
#: Tracks of a block, and projections whose signs deal a larger video into blocks.
BLOCK_TRACKS, SIGNS = 2048, 16


def reference_search(queries: DataFrame, index: DataFrame, k: int = 5, prefetch: int = 8) -> DataFrame:
    """Per query (``query_id``, ``q``) the best photo of each product among the
    nearest ``prefetch * k`` photos of ``index`` (``row_id``, ``v``,
    ``product_key``), ranked, with the margin to the next product (0 from the last)."""
    found = _nearest(queries, index, k * prefetch)
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    top = found.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k * prefetch)
    best = top.groupBy("query_id", "product_key").agg(F.max("score").alias("score"), F.min_by("row_id", "n").alias("row_id"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return (
        best.withColumn("rank", F.row_number().over(ranked))
        .withColumn("margin", F.col("score") - F.coalesce(F.lead("score").over(ranked), F.lit(0.0)))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "product_key", "row_id", "score", "margin")
    )


def _nearest(queries: DataFrame, index: DataFrame, most: int) -> DataFrame:
    """At least each query's ``most`` nearest rows of the index, by score and then ``row_id``.

    An index of up to ``SHARD_ROWS`` is one shard.  A larger one is dealt to the
    nearest of some sampled rows; the angles from a centre to the rows of its
    cluster and to the query bound every score in the cluster.  A query first
    visits the clusters that promise most until they hold ``most`` rows, then
    those whose bound reaches its ``most``-th score, and no other."""
    n = index.count()
    rows = index.select("row_id", "product_key", unit("v").alias("v"))
    asked = queries.select("query_id", unit("q").alias("v"))
    if n <= SHARD_ROWS:
        return _scores(rows.withColumn("shard", F.lit(0)), asked.withColumn("shard", F.lit(0)), 1, most)
    centres = _centres(rows, min(CLUSTERS, -(-n // CLUSTER_ROWS)))
    dealt = written(_dealt(rows, centres))
    spans = dealt.groupBy("cluster").agg(F.min("angle"), F.max("angle"), F.count(F.lit(1))).collect()  # a row for each centre
    spans = sorted(tuple(r) for r in spans)
    shards = [-(-r[3] // SHARD_ROWS) for r in spans]
    base = np.concatenate([[0], np.cumsum(shards)])
    table = rows.sparkSession.createDataFrame([(r[0], int(b), s) for r, b, s in zip(spans, base, shards)], "cluster int, base int, shards int")
    small = F.broadcast(table)  # as many rows as centres
    held = dealt.join(small, "cluster").select((F.col("base") + F.pmod(F.xxhash64("row_id"), F.col("shards"))).cast("int").alias("shard"), "row_id", "product_key", "v")

    def visit(plan: DataFrame) -> DataFrame:
        at = plan.select("query_id", "v", "kth", F.explode("clusters").alias("cluster")).join(small, "cluster")
        at = at.select("query_id", "v", "kth", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("shards") - 1)).alias("shard"))
        return _scores(held, at, int(base[-1]), most)

    first = written(visit(_visits(asked.withColumn("kth", F.lit(None).cast("double")), centres, spans, most, False)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    kth = first.withColumn("n", place).where(F.col("n") == most).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    known = asked.join(kth, F.col("query_id").eqNullSafe(F.col("id")), "left").select("query_id", "v", "kth")
    return first.unionByName(visit(_visits(known, centres, spans, most, True)))


def _centres(rows: DataFrame, most: int) -> np.ndarray:
    """Different unit vectors of one length (the most frequent) from ``most`` rows by a hash of their id."""
    found = rows.where("v IS NOT NULL").orderBy(F.xxhash64("row_id"), "row_id").limit(most).select("v").collect()
    vectors = [r["v"] for r in found if None not in r["v"]]
    lengths = [len(v) for v in vectors]
    width = max(set(lengths), key=lengths.count, default=0)
    kept = [v for v in vectors if len(v) == width]
    m = np.array(kept, dtype=float).reshape(len(kept), width)
    m = m[_is_unit(m)]
    return np.unique(m, axis=0) if len(m) else np.zeros((0, width))


def _is_unit(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return np.abs((m * m).sum(axis=1) - 1) < 1e-6


def _angles(vectors, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of vectors to all centres, and which vectors these bound: not null, of unit length and the centres' dimension."""
    m, length = _matrix(vectors)
    width = centres.shape[1]
    fine = (length == width) & (len(centres) > 0)
    m = np.pad(m, ((0, 0), (0, max(0, width - m.shape[1]))))[:, :width]
    fine &= _is_unit(m)
    return np.arccos(np.clip(np.nan_to_num(m) @ centres.T, -1, 1)), fine


def _dealt(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows with the ``cluster`` of their nearest centre and their ``angle`` to it; those that no angle bounds are in cluster -1."""

    def deal(it):
        for batch in it:
            for a in range(0, len(batch), QUERY_ROWS * 16):
                part = batch.slice(a, QUERY_ROWS * 16)
                angle, fine = _angles(part.column("v"), centres)
                at = np.where(fine, angle.argmin(axis=1), -1) if len(centres) else np.full(len(part), -1)
                own = np.where(fine, angle[np.arange(len(at)), at], 0.0) if len(centres) else np.zeros(len(part))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at, pa.int32()), pa.array(own)], [*part.schema.names, "cluster", "angle"])

    return rows.mapInArrow(deal, StructType([*rows.schema.fields, StructField("cluster", IntegerType()), StructField("angle", DoubleType())]))


def _visits(asked: DataFrame, centres: np.ndarray, spans: list[tuple], most: int, again: bool) -> DataFrame:
    """Each query with the ``clusters`` that it has to visit: at first those that
    promise most and all that no angle bounds, ``again`` the others that reach its
    ``kth`` score.  A query that no angle bounds visits all at first."""
    number = np.array([s[0] for s in spans])
    low, high = np.array([s[1] for s in spans]), np.array([s[2] for s in spans])
    size = np.where(number >= 0, np.array([s[3] for s in spans]), 0)

    def plan(it):
        for batch in it:
            for a in range(0, len(batch), QUERY_ROWS * 16):
                part = batch.slice(a, QUERY_ROWS * 16)
                angle, fine = _angles(part.column("v"), centres)
                to = angle[:, np.maximum(number, 0)] if len(centres) else np.zeros((len(part), len(number)))
                apart = np.maximum(np.maximum(to - high, low - to) - ANGLE_SLACK, 0)
                bound = np.where(number < 0, np.inf, np.cos(apart))
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(size[order], axis=1) - size[order]
                early = np.zeros(bound.shape, bool)
                np.put_along_axis(early, order, before < most, axis=1)
                early |= ~fine[:, None]
                if again:
                    kth = part.column("kth").to_numpy(zero_copy_only=False).astype(float)
                    unknown = part.column("kth").is_null().to_numpy(zero_copy_only=False)
                    chosen = ~early & ((bound >= kth[:, None] - SLACK) | unknown[:, None])
                else:
                    chosen = early
                count = chosen.sum(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(number[np.nonzero(chosen)[1]], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("query_id"), part.column("v"), part.column("kth"), lists], ["query_id", "v", "kth", "clusters"])

    schema = StructType([asked.schema["query_id"], asked.schema["v"], asked.schema["kth"], StructField("clusters", ArrayType(IntegerType()))])
    return asked.mapInArrow(plan, schema)


def _scores(rows: DataFrame, asked: DataFrame, shards: int, most: int) -> DataFrame:
    """Each query's ``most`` nearest rows of every ``shard`` that it asks, without
    those below its ``kth`` score where that is known; a task holds one shard and the
    queries pass it in blocks of ``QUERY_ROWS``."""
    row_kind, key_kind, query_kind = rows.schema["row_id"].dataType, rows.schema["product_key"].dataType, asked.schema["query_id"].dataType
    none = F.lit(None).cast("double").alias("kth")
    rows = rows.select("shard", F.lit(False).alias("asks"), F.lit(None).cast(query_kind).alias("query_id"), "row_id", "product_key", "v", none)
    asked = asked.select("shard", F.lit(True).alias("asks"), "query_id", F.lit(None).cast(row_kind).alias("row_id"), F.lit(None).cast(key_kind).alias("product_key"), "v", "kth" if "kth" in asked.columns else none)

    def search(it):
        at, held, shard = None, [], None
        for batch in it:
            where, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks"))
            cuts = np.flatnonzero((where[1:] != where[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(where)]):
                part = batch.slice(a, b - a)
                if where[a] != at:
                    at, held, shard = where[a], [], None
                if not asks[a]:
                    held.append(part)
                elif held:
                    if shard is None:
                        table = pa.Table.from_batches(held)
                        shard = table.select(["row_id", "product_key"]).combine_chunks(), _matrix(table.column("v"))
                        held = [held[0].slice(0, 1)]
                    for c in range(0, len(part), QUERY_ROWS):
                        block = part.slice(c, QUERY_ROWS)
                        i, j, score = _best(_matrix(block.column("v")), shard[1], most)
                        least = block.column("kth").take(pa.array(i))
                        can = pc.or_(pc.or_kleene(pc.is_null(least), pc.fill_null(pc.is_nan(score), False)), pc.fill_null(pc.greater_equal(score, pc.subtract(least, SLACK)), False))
                        i, j, score = i[can.to_numpy(zero_copy_only=False)], j[can.to_numpy(zero_copy_only=False)], score.filter(can)
                        ids = shard[0].take(pa.array(j))
                        columns = [block.column("query_id").take(pa.array(i)), *(x.combine_chunks() for x in ids.columns), score]
                        yield pa.RecordBatch.from_arrays([x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns], ["query_id", "row_id", "product_key", "score"])

    schema = StructType([StructField("query_id", query_kind), StructField("row_id", row_kind), StructField("product_key", key_kind), StructField("score", DoubleType())])
    return rows.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "asks", "row_id").mapInArrow(search, schema)


def _matrix(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows that end in zeros, and their lengths (-1: null, or with a null inside)."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = pa.concat_arrays(vectors.chunks)
    n, flat = len(vectors), vectors.flatten()
    length = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    kept = np.maximum(length, 0)
    out = np.zeros((n, int(kept.max(initial=0))))
    out[np.arange(out.shape[1]) < kept[:, None]] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        length[np.repeat(np.arange(n), kept)[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, length


def _best(asked: tuple, rows: tuple, most: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(query, row, score) of each query's ``most`` best rows, the first of equals;
    NaN is above all scores, null (unlike lengths, null elements) below.

    A matrix product picks all rows that can be among them; their scores are then
    summed in the order of ``dot``, so equal vectors have equal scores anywhere."""
    (q, q_len), (v, v_len) = asked, rows
    width = min(q.shape[1], v.shape[1])
    q, v = q[:, :width], v[:, :width]
    rough = q @ v.T
    rough[np.isnan(rough)] = np.inf
    if len(lengths := np.unique(np.concatenate([q_len, v_len]))) > 1 or lengths[0] < 0:
        rough[(q_len[:, None] != v_len) | (q_len < 0)[:, None]] = -np.inf
    if most < len(v):
        least = np.partition(rough, len(v) - most, axis=1)[:, len(v) - most]
        i, j = np.nonzero(rough >= least[:, None] - SLACK)
    else:
        i, j = np.nonzero(np.ones(rough.shape, bool))
    score = np.zeros(len(i))
    for d in range(width):
        score += q[i, d] * v[j, d]
    none = np.isneginf(rough[i, j])
    order = np.lexsort((j, -np.where(none, -np.inf, np.where(np.isnan(score), np.inf, score)), i))
    first = np.searchsorted(i, np.arange(len(q)))
    order = order[np.arange(len(i)) - first[i] < most]
    return i[order], j[order], pa.array(score[order], mask=none[order])


def visual_recognition(matches: DataFrame, score: float = 0.78, margin: float = 0.035) -> DataFrame:
    """Best matches that are near and clear enough; they give brand and category, never a product."""
    good = (F.col("score") >= score) & (F.col("margin") >= margin)
    return matches.where(F.col("rank") == 1).withColumn("status", F.when(good, "brand_only").otherwise("unknown"))


def repass_edges(tracks: DataFrame, key: str, similarity: float = 0.96, min_gap: int = 12) -> DataFrame:
    """Pairs of tracks of one video that may be one object seen again: spans apart
    by ``min_gap`` frames, embeddings alike.  ``tracks``: key, ord, first, last, v.

    A video of up to ``BLOCK_TRACKS`` is a block.  A larger one is dealt into
    blocks by the signs of fixed projections; only pairs of blocks meet whose spans
    can be that far apart and whose centres' angle, less the blocks' radii, allows
    the similarity.  A task compares two blocks by a matrix product, and sums the
    similarities that it lets through in order.  Tracks without a span or vector
    have no pair."""
    t = tracks.select(F.col(key).alias("k"), "ord", "first", "last", unit("v").alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull() & F.col("first").isNotNull() & F.col("last").isNotNull())
    names = ["ord", "first", "last", "v"]
    schema = StructType([StructField("k", t.schema["k"].dataType), StructField("a_ord", t.schema["ord"].dataType), StructField("b_ord", t.schema["ord"].dataType), StructField("sim", DoubleType()), StructField("gap", t.schema["first"].dataType)])

    def inside(key, block):
        return _alike(key[0], block, block, similarity, min_gap, schema)

    def across(key, a, b):
        return _alike(a.column("k")[0] if len(a) else None, a, b, similarity, min_gap, schema) if len(a) and len(b) else _alike(None, a.slice(0, 0), b.slice(0, 0), similarity, min_gap, schema)

    def edges(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("k").alias(key), "a_ord", "b_ord", "sim", "gap")

    sizes = t.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    large = sizes.where(F.col("n") > BLOCK_TRACKS)
    if large.isEmpty():
        return edges(t.withColumn("block", F.lit(0)).groupBy("k", "block").applyInArrow(inside, schema))
    blocks = written(_blocks(t, large))
    heads = written(blocks.groupBy("k", "block").applyInArrow(_head, StructType([schema["k"], *HEAD.fields])))
    a, b = (heads.select("k", *[F.col(c).alias(f"{side}_{c}") for c in HEAD.names]) for side in ("a", "b"))
    far = (F.col("a_high") - F.col("b_low") >= min_gap) | (F.col("b_high") - F.col("a_low") >= min_gap)
    angle = F.acos(F.greatest(F.least(dot("a_centre", "b_centre"), F.lit(1.0)), F.lit(-1.0)))
    near = angle - F.col("a_radius") - F.col("b_radius") <= math.acos(max(-1.0, min(1.0, similarity))) + ANGLE_SLACK
    unbound = F.col("a_odd") | F.col("b_odd") | (F.size("a_centre") != F.size("b_centre"))
    met = written(a.join(b, "k").where(F.col("a_block") < F.col("b_block")).where(far & (unbound | near)).select("k", "a_block", "b_block"))
    pairs = met.withColumnRenamed("k", "video")
    sides = [blocks.join(pairs, (F.col("k") == F.col("video")) & (F.col("block") == F.col(f"{s}_block"))) for s in ("a", "b")]
    sides = [x.select([F.col(c).alias(c) for c in ("k", "a_block", "b_block", *names)]) for x in sides]
    crossed = sides[0].groupBy("k", "a_block", "b_block").cogroup(sides[1].groupBy("k", "a_block", "b_block")).applyInArrow(across, schema)
    return edges(blocks.groupBy("k", "block").applyInArrow(inside, schema).unionAll(crossed))


HEAD = (
    StructType().add("block", LongType()).add("centre", ArrayType(DoubleType())).add("radius", DoubleType())
    .add("odd", BooleanType()).add("low", DoubleType()).add("high", DoubleType())
)


def _blocks(t: DataFrame, large: DataFrame) -> DataFrame:
    """Tracks with their ``block``, of about ``BLOCK_TRACKS`` at most: by the first
    signs of their projections, and by a hash where these agree too often."""
    signed = t.mapInArrow(_signs, StructType([*t.schema.fields, StructField("sign", IntegerType())]))
    # one row for more than so many tracks of a video, so this is small
    bits = large.select("k", F.least(F.ceil(F.log2(F.col("n") / BLOCK_TRACKS)) + 2, F.lit(SIGNS)).cast("int").alias("bits"))
    cut = signed.join(F.broadcast(bits), "k", "left").withColumn("sign", F.expr(f"shiftright(sign, {SIGNS} - coalesce(bits, 0))")).drop("bits")
    cut = written(cut)
    parts = cut.groupBy("k", "sign").agg(F.ceil(F.count(F.lit(1)) / BLOCK_TRACKS).alias("parts")).where("parts > 1")
    joined = cut.join(F.broadcast(parts), ["k", "sign"], "left")  # likewise
    return joined.withColumn("block", F.shiftleft(F.col("sign").cast("long"), 32) + F.pmod(F.xxhash64("ord"), F.coalesce("parts", F.lit(1)))).drop("sign", "parts")


def _signs(it):
    """Tracks with the signs of ``SIGNS`` projections of their vectors as one number."""
    for batch in it:
        m, _ = _matrix(batch.column("v"))
        plane = np.random.default_rng(7).standard_normal((SIGNS, max(1, m.shape[1])))[:, : m.shape[1]]  # the same in every task
        bit = np.nan_to_num(m) @ plane.T > 0
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bit @ (1 << np.arange(SIGNS)[::-1]), pa.int32())], [*batch.schema.names, "sign"])


def _head(key, block):
    """Centre, radius and range of spans of a block; ``odd`` if they bound nothing."""
    m, length = _matrix(block.column("v"))
    fine = _is_unit(m) & (length == length.max(initial=0))
    centre = m.sum(axis=0)
    size = np.linalg.norm(centre)
    odd = not (fine.all() and size > 1e-6)
    centre = np.zeros(len(centre)) if odd else centre / size
    radius = 0.0 if odd else float(np.arccos(np.clip(m @ centre, -1, 1)).max())
    low, high = pc.min(block.column("last")).as_py(), pc.max(block.column("first")).as_py()
    columns = [pa.array([x.as_py()], x.type) for x in key] + [pa.array([centre]), pa.array([radius]), pa.array([odd]), pa.array([float(low)]), pa.array([float(high)])]
    return pa.table(columns, names=["k", *HEAD.names])


def _alike(k, a: pa.Table, b: pa.Table, similarity: float, min_gap: int, schema: StructType) -> pa.Table:
    """Pairs of two blocks (or of one with itself), each once."""
    one = a is b
    kinds = to_arrow_schema(schema)
    if not len(a) or not len(b):
        return kinds.empty_table()
    (v, v_len), (w, w_len) = _matrix(a.column("v")), _matrix(b.column("v"))
    width = min(v.shape[1], w.shape[1])
    v, w = v[:, :width], w[:, :width]
    first, last = ([t.column(c).to_numpy() for t in (a, b)] for c in ("first", "last"))
    out = []
    for at in range(0, len(v), QUERY_ROWS * 4):
        to = slice(at, at + QUERY_ROWS * 4)
        rough = v[to] @ w.T
        gap = np.maximum(first[1][None, :] - last[0][to, None], first[0][to, None] - last[1][None, :])
        ok = (gap >= max(min_gap, 1)) & (v_len[to, None] == w_len[None, :]) & (v_len[to, None] >= 0)
        i, j = np.nonzero(ok & ~(rough < similarity - SLACK))
        i += at
        if one:
            i, j = i[i < j], j[i < j]
        sim = np.zeros(len(i))
        for d in range(width):
            sim += v[i, d] * w[j, d]
        keep = ~(sim < similarity)
        out.append((i[keep], j[keep], sim[keep]))
    i, j, sim = (np.concatenate(x) for x in zip(*out))
    gap = np.maximum(first[1][j] - last[0][i], first[0][i] - last[1][j])
    left, right = a.column("ord").take(pa.array(i)), b.column("ord").take(pa.array(j))
    swap = pc.greater(left, right)
    found = pa.table([pa.array([k.as_py()] * len(i), kinds.field("k").type), pc.if_else(swap, right, left), pc.if_else(swap, left, right), pa.array(sim), pa.array(gap)], names=kinds.names)
    return found.filter(pc.not_equal(left, right)).cast(kinds)
