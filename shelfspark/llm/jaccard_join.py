"""Operator 2: n-gram Jaccard join through a MinHash LSH forest.

A document's signature has ``DEPTH`` values for each of ``TREES`` trees.  A tree is
the trie of its part of all signatures, kept as rows in sorted order: what a
document shares with its neighbours in that order is the longest prefix that it
shares with any document.  Documents meet at their longest prefixes first and
are verified on their exact shingle sets.  From the Jaccard index of each link
found, the chance of finding it at that depth is known, so its inverse tells
how many links like it are still missing (with a few links at the threshold
assumed beside those found).  Until the recall measured so reaches ``RECALL``,
prefixes are shortened to the depth at which it is expected to, and only
documents that share that much with a neighbour meet again.

Equal texts are one class, found by a hash and counted, never compared.  A pair
that meets in several trees, or met at a deeper level, is verified once; nodes
whose members are those of a node done before are dropped beforehand.  A node of
many or long members is dealt into blocks by hash, and each pair of blocks is a
task of its own, so no task holds more than two blocks.  Shingle sets are made
once a level and no text is sent to a block; of a pair of blocks only link
counts, a spanning forest and a histogram are written, never the pairs.

Shingles are runs of ``WORDS`` words (separated by ASCII white space); a shorter
text with words is one shingle.  Defined results: a text without words (null,
empty) links to nothing, not even its like; equal texts link; a class is a
connected component of links and is named by its smallest id; ``n_links`` counts
the other rows that a row links to, copies included; repeated rows count as
copies; other columns are not read.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byteblock import BLOCK, Block, mix
from .common import by_place, cut, give_back, id_text, place, text_blocks
from .components import components

WORDS = 5
SIMILARITY = Fraction(4, 5)
TREES = 20
#: Values (of two bytes) in a full prefix.
DEPTH = 8
RECALL = 0.99999
#: Links at the threshold that the estimate takes for found besides those it has seen.
ASSUMED = 10
#: Bins of the Jaccard index from the threshold to 1.
BINS = 20
#: Documents and bytes of shingle sets in one block of a node, about.
BLOCK_DOCS = 512
BLOCK_BYTES = 4 << 20
#: Rows (a key and an id) that may be broadcast to fetch texts; more are joined by shuffle.
BROADCAST_ROWS = 200_000
SEED = 77


def meets(similarity, depth: int, trees: int = TREES):
    """The chance that a pair shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def floor_depth(similarity: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that hardly any pair at the threshold fails to share."""
    while depth > 1 and meets(similarity, depth, trees) < 0.999999:
        depth -= 1
    return depth


def recall_at(found: np.ndarray, similarity: float, depth: int, then: int | None = None, trees: int = TREES) -> float:
    """The recall at depth ``then`` (``depth`` if none), from a histogram of the
    Jaccard indices of the links found at ``depth``."""
    edge = similarity + (1 - similarity) * np.arange(BINS) / BINS
    total = found / meets(edge, depth, trees)
    total[0] += ASSUMED / meets(edge[0], depth, trees)
    return float((total * meets(edge, then or depth, trees)).sum() / total.sum())


def shingles(b: Block, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles and the text of each, texts in order."""
    h, first = b.grams(n)
    text = b.word_text[first]
    extra_h, extra_t = [], []
    for k in range(1, n):
        some = np.flatnonzero(b.n_words == k)
        if len(some):
            at = b.word_at[some]
            out = np.full(len(some), k, np.uint64)
            for j in range(k):
                out = out * np.uint64(0x9E3779B97F4A7C15) + b.word_hash[at + j]
            extra_h.append(mix(out))
            extra_t.append(some)
    if extra_h:
        h, text = np.concatenate([h, *extra_h]), np.concatenate([text, *extra_t])
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    return h, text


def minima(h: np.ndarray, text: np.ndarray, trees: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, their values by tree and place)."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros((0, trees * depth), "<u2")
    at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    rng = np.random.default_rng(SEED)
    odd = rng.integers(0, 1 << 32, size=(trees * depth, 3), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(at), trees * depth), "<u2")
    v, spare = np.empty_like(x), np.empty_like(x)
    for i, (a, b, c) in enumerate(odd):
        np.add(x, b, out=v)
        v *= a
        np.right_shift(v, 15, out=spare)
        v ^= spare
        v *= c
        out[:, i] = (np.minimum.reduceat(v, at) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return text[at], out


def signatures(rows: DataFrame, id_kind: str, trees: int, n: int) -> DataFrame:
    """``_id``, ``key`` (hash of the text), ``sig`` (null without words) and ``size`` (shingles)."""

    def sign(it):
        for batch in it:
            for a, texts in text_blocks(batch, BLOCK):
                sig: list = [None] * len(texts)
                h, text = shingles(Block(texts), n)
                has, values = minima(h, text, trees)
                for i, v in zip(has.tolist(), values):
                    sig[i] = v.tobytes()
                size = np.bincount(text, minlength=len(texts))
                keys = [hashlib.md5(t.encode("utf-8"), usedforsecurity=False).digest() for t in texts]
                ids = batch.column("_id").slice(a, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(keys, pa.binary()), pa.array(sig, pa.binary()), pa.array(size, pa.int64())], ["_id", "key", "sig", "size"]
                )
        give_back()

    return rows.mapInArrow(sign, f"_id {id_kind}, key binary, sig binary, size long")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    """A column of byte strings of one width as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def shared_prefixes(rows: pa.RecordBatch) -> np.ndarray:
    """How many values each row shares with the next one; none across trees."""
    tree = rows.column("tree").to_numpy(zero_copy_only=False)
    sig = _fixed(rows.column("sig"), 2 * DEPTH).view("<u2")
    out = np.cumprod(sig[1:] == sig[:-1], axis=1).sum(axis=1)
    out[tree[1:] != tree[:-1]] = 0
    return out


def trie(distinct: DataFrame, trees: int, floor: int) -> DataFrame:
    """The sorted tries: ``tree``, ``sig`` (of that tree), ``key``, ``size`` and ``depth``,
    the longest prefix shared with a neighbour, of at least ``floor`` values.

    A row at a rim of its partition counts as sharing all, as its neighbour
    stands elsewhere; nodes without a second member are dropped later."""
    width = 2 * DEPTH
    entries = distinct.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).select(
        "tree", F.expr(f"substring(sig, tree * {width} + 1, {width})").alias("sig"), "key", "size"
    )

    def run(it):
        last, before = None, DEPTH

        def told(rows: pa.RecordBatch, depth: np.ndarray):
            keep = depth >= floor
            cols = [c.filter(pa.array(keep)) for c in rows.columns]
            return pa.RecordBatch.from_arrays([*cols, pa.array(depth[keep], pa.int32())], ["tree", "sig", "key", "size", "depth"])

        for batch in it:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            shares = shared_prefixes(rows)
            left = np.concatenate([[before], shares])
            yield told(rows.slice(0, len(shares)), np.maximum(left[:-1], shares))
            last, before = rows.slice(len(shares)), left[-1]
        if last is not None:
            yield told(last, np.array([DEPTH]))
        give_back()

    return (
        entries.repartitionByRange("tree", "sig", "key")
        .sortWithinPartitions("tree", "sig", "key")
        .mapInArrow(run, "tree int, sig binary, key binary, size long, depth int")
    )


def shingle_sets(keyed: DataFrame, n: int) -> DataFrame:
    """``key`` and ``grams``, the sorted distinct shingle hashes (64 bits each)."""

    def run(it):
        for batch in it:
            for a, texts in text_blocks(batch, BLOCK):
                h, text = shingles(Block(texts), n)
                order = np.lexsort((h, text))
                h, text = h[order], text[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (text[1:] != text[:-1])]) if len(h) else np.zeros(0, bool)
                h, text = h[new], text[new]
                at = np.searchsorted(text, np.arange(len(texts) + 1))
                sets = [h[i:j].tobytes() for i, j in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, len(texts)), pa.array(sets, pa.binary())], ["key", "grams"])
        give_back()

    return keyed.select("key", "_text").mapInArrow(run, "key binary, grams binary")


def prefix_codes(sig: np.ndarray, depth: int) -> np.ndarray:
    """A number for the first ``depth`` values in each tree, by document and tree."""
    words = sig.view("<u8").reshape(len(sig), -1, 2)
    low = words[:, :, 0] & np.uint64((1 << 16 * min(depth, 4)) - 1)
    high = words[:, :, 1] & np.uint64((1 << 16 * max(depth - 4, 0)) - 1)
    return mix(low ^ mix(high + np.uint64(1)))


def jaccard(sets: list[np.ndarray], eligible: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and of the unions of all pairs of some sets of
    distinct hashes (only the upper triangle and eligible pairs are of use)."""
    m = len(sets)
    size = np.fromiter(map(len, sets), np.int32, count=m)
    if m == 2:
        both = np.zeros((2, 2), np.int32)
        both[0, 1] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return both, size[:, None] + size[None, :] - both
    value, doc = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    column = np.cumsum(np.concatenate([[True], value[1:] != value[:-1]])) - 1 if len(value) else value.astype(np.int64)
    many = np.bincount(column)[column] > 1 if len(column) else np.zeros(0, bool)
    doc, column = doc[many], column[many]
    common = np.zeros((m, m), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        step = 2048
        edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + step, step))
        for k, (a, e) in enumerate(zip(edges[:-1], edges[1:])):
            part = np.zeros((m, min(step, int(column[-1]) + 1 - k * step)), np.float32)
            part[doc[a:e], column[a:e] - k * step] = 1
            common += part @ part.T
    both = common.astype(np.int32)
    return both, size[:, None] + size[None, :] - both


def _forest(links: np.ndarray) -> list[int]:
    """Root of each member under the links."""
    root = list(range(len(links)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(links)):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(links))]


LINK_COLUMNS = ["key", "first_id", "root_key", "root_id", "links", "found"]


def verify(placed: DataFrame, id_kind: str, similarity: Fraction, depth: int, deeper: int | None) -> DataFrame:
    """``key``, ``first_id``, ``root_key``, ``root_id`` (a member of its group, perhaps
    itself) and ``links``; rows without a key have ``found``, a histogram of links."""
    least = float(similarity)

    def group(tree: int, lo: int, hi: int, rows: pa.RecordBatch, found: np.ndarray):
        keys = rows.column("key").to_pylist()
        once = np.array(sorted({k: i for i, k in reversed(list(enumerate(keys)))}.values()))
        if len(once) < 2:
            return
        sig = _fixed(rows.column("sigs"), len(rows.column("sigs")[0].as_py()))[once]
        side = rows.column("blk").to_numpy(zero_copy_only=False)[once]
        code = prefix_codes(sig, depth)
        ok = np.triu(code[:, None, tree] == code[None, :, tree], 1)
        for t in range(tree):  # met in an earlier tree
            ok &= code[:, None, t] != code[None, :, t]
        if deeper:  # met at a deeper level
            code = prefix_codes(sig, deeper)
            for t in range(code.shape[1]):
                ok &= code[:, None, t] != code[None, :, t]
        if lo != hi:
            ok &= side[:, None] != side[None, :]
        used = np.flatnonzero(ok.any(axis=0) | ok.any(axis=1))
        if not len(used):
            return
        ok, once = ok[np.ix_(used, used)], once[used]
        grams = rows.column("grams")
        both, union = jaccard([np.frombuffer(grams[int(i)].as_py(), np.uint64) for i in once], ok)
        # below 2**31, as a set of more than 2**28 hashes is no row
        link = ok & (both * similarity.denominator >= union * similarity.numerator) & (union > 0)
        if not link.any():
            return
        bins = ((both[link] / union[link] - least) / max(1 - least, 1e-9) * BINS).astype(int)
        found += np.bincount(np.clip(bins, 0, BINS - 1), minlength=BINS)
        weight = rows.column("copies").to_numpy(zero_copy_only=False)[once]
        first = rows.column("first_id")
        count = link @ weight + link.T @ weight
        root = _forest(link)
        for i in np.flatnonzero(count):
            own, top = int(once[i]), int(once[root[i]])
            yield keys[own], first[own].as_py(), keys[top], first[top].as_py(), int(count[i]), None

    def run(it):
        at, parts, out, id_type = None, [], [], None
        found = np.zeros(BINS, np.int64)

        def flush():
            if parts and sum(p.num_rows for p in parts) > 1:
                out.extend(group(*at[1:], pa.Table.from_batches(parts).combine_chunks().to_batches()[0], found))

        def batch_of():
            kinds = [pa.binary(), id_type, pa.binary(), id_type, pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], k) for c, k in enumerate(kinds)], LINK_COLUMNS)

        for batch in it:
            if not batch.num_rows:
                continue
            id_type = batch.schema.field("first_id").type
            names = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "tree", "lo", "hi")]
            new = np.any([n[1:] != n[:-1] for n in names], axis=0)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                here = tuple(int(n[a]) for n in names)
                if here != at:
                    flush()
                    at, parts = here, []
                parts.append(batch.slice(a, b - a))
            if len(out) > 5000:
                yield batch_of()
                out = []
        flush()
        parts = []
        give_back()
        if id_type is not None:
            out.append((None, None, None, None, 0, found.tolist()))
            yield batch_of()

    return placed.mapInArrow(run, f"key binary, first_id {id_kind}, root_key binary, root_id {id_kind}, links long, found array<long>")


def level(texts: DataFrame, tries: DataFrame, distinct: DataFrame, done: DataFrame | None, depth: int, deeper: int | None, id_kind: str, similarity: Fraction, n: int):
    """Documents that share ``depth`` values but not ``deeper`` ones meet: (their
    links, the nodes' fingerprints).  ``done`` has the fingerprints of deeper nodes."""
    nodes = tries.where(F.col("depth") >= depth).select(
        "key", "tree", "size", F.xxhash64("tree", F.expr(f"substring(sig, 1, {2 * depth})")).alias("bucket")
    )
    shared = (
        nodes.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("key")).alias("x"),
            F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"),
            F.min("tree").alias("tree"),
            F.sum("size").alias("grams"),
        )
        .where("n > 1")
        .groupBy("n", "x", "y")  # nodes with the same members: the first tree's stays
        .agg(F.min(F.struct("tree", "bucket")).alias("node"), F.first("grams").alias("grams"))
    )
    if done is not None:
        shared = shared.join(done, ["n", "x", "y"], "left_anti")
    shared = cut(shared)
    members = (
        nodes.select("key", "tree", "bucket")
        .join(shared.select(F.col("node.bucket").alias("b"), "n", "grams"), F.col("bucket") == F.col("b"))
        .groupBy("key")
        .agg(F.collect_list(F.struct("bucket", "tree", "n", "grams")).alias("in"))  # at most one entry for each tree
    )
    wanted = cut(members.join(distinct, "key").select(F.col("key").alias("k"), "first_id", "copies", F.col("sig").alias("sigs"), "in"))
    few = wanted.count() <= BROADCAST_ROWS
    keyed = texts.withColumn("key", F.unhex(F.md5(F.col("_text").cast("binary"))))
    first = wanted.select("k", "first_id")
    # at most BROADCAST_ROWS keys leave the other texts where they are
    keyed = keyed.join(F.broadcast(first) if few else first.hint("merge"), (F.col("key") == F.col("k")) & F.col("_id").eqNullSafe(F.col("first_id")), "left_semi")
    count = F.greatest(F.ceil(F.col("node.n") / BLOCK_DOCS), F.ceil(F.col("node.grams") * 8 / BLOCK_BYTES)).cast("int")
    placed = (
        shingle_sets(keyed, n)
        .join(wanted.hint("merge"), F.col("key") == F.col("k"))
        .select("key", "first_id", "grams", "sigs", "copies", F.explode("in").alias("node"))
        .withColumn("count", count)
        .withColumn("blk", F.pmod(F.xxhash64("key", F.col("node.bucket")), F.col("count")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
        .select(
            F.col("node.bucket").alias("bucket"),
            F.col("node.tree").alias("tree"),
            F.least("blk", "other").alias("lo"),
            F.greatest("blk", "other").alias("hi"),
            "blk",
            "key",
            "first_id",
            "grams",
            "sigs",
            "copies",
        )
        .repartition("bucket", "lo", "hi")
        .sortWithinPartitions("bucket", "lo", "hi", "key")
    )
    return cut(verify(placed, id_kind, similarity, depth, deeper)), shared.select("n", "x", "y")


def all_links(texts: DataFrame, distinct: DataFrame, id_kind: str, similarity: Fraction, n: int, trees: int, recall: float) -> tuple[DataFrame, list[int]]:
    """The links (see :func:`verify`) of all levels, and the depths that were taken."""
    least = float(similarity)
    floor = floor_depth(least, trees)
    tries = cut(trie(distinct, trees, floor))
    depth, deeper, done, links = DEPTH, None, None, None
    depths, found = [], np.zeros(BINS)
    while True:
        depths.append(depth)
        new, nodes = level(texts, tries, distinct, done, depth, deeper, id_kind, similarity, n)
        for r in new.where("found IS NOT NULL").select(F.posexplode("found").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect():
            found[r["bin"]] += r["n"]  # BINS rows at most
        new = new.where("key IS NOT NULL")
        links = new if links is None else links.unionByName(new)
        done = nodes if done is None else done.unionByName(nodes)
        if depth == floor or recall_at(found, least, depth, trees=trees) >= recall:
            return links.drop("found"), depths
        shorter = [d for d in range(depth - 1, floor, -1) if recall_at(found, least, depth, d, trees) >= recall]
        depth, deeper = shorter[0] if shorter else floor, depth


def jaccard_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: Fraction = SIMILARITY,
    words: int = WORDS,
    trees: int = TREES,
    recall: float = RECALL,
) -> DataFrame:
    """``id_col``, ``class_id``, ``n_links`` and ``_key`` (hash of the text) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = id_text(docs, id_col, text_col)
    signed = cut(signatures(texts, kind, trees, words))
    distinct = cut(
        signed.where(F.col("sig").isNotNull())
        .groupBy("key")
        .agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    )
    links, _ = all_links(texts, distinct, kind, similarity, words, trees, recall)
    # a node is (smallest id of its copies, key), so the smallest node of a
    # component carries the class's id and no join by component is needed
    def node(i: str, k: str):
        return F.struct(F.col(i).alias("i"), F.col(k).alias("k"))

    rooted = components(links.select(node("first_id", "key").alias("u"), node("root_id", "root_key").alias("v"))).select(
        F.col("node.k").alias("node_key"), F.col("root.i").alias("root_id"), F.lit(True).alias("below")
    )
    counted = links.groupBy("key").agg(F.sum("links").alias("links"))
    # written, so that the last join reads two plain shuffles and a hot key can be split
    told = cut(
        distinct.drop("sig", "size")
        .join(counted, "key", "left")
        .where((F.col("copies") > 1) | F.col("links").isNotNull())
        .join(rooted, F.col("key") == F.col("node_key"), "left")
        .select(
            F.col("key").alias("k"),
            F.when(F.col("below"), F.col("root_id")).otherwise(F.col("first_id")).alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"),
            F.lit(True).alias("told"),
        )
    )
    return signed.join(told, F.col("key") == F.col("k"), "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("told"), F.col("class_id")).otherwise(F.col("_id")).alias("class_id"),
        F.coalesce("n", F.lit(0)).alias("n_links"),
        F.col("key").alias("_key"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that name their class (smallest id), one for each;
    all columns as they were.  Rows without words all stay."""
    classes = cut(jaccard_classes(docs, id_col, text_col, **options)).toDF("_i", "class_id", "n_links", "_k")
    rows, i, t = by_place(docs), place(docs, id_col), place(docs, text_col)
    spare = classes.where(~F.col("_i").eqNullSafe(F.col("class_id"))).select("_i", "_k").distinct()
    few = spare.count() <= BROADCAST_ROWS
    key = F.unhex(F.md5(F.coalesce(F.col(t).cast("string"), F.lit("")).cast("binary")))
    left = rows.join(F.broadcast(spare) if few else spare.hint("merge"), (key == F.col("_k")) & F.col(i).eqNullSafe(F.col("_i")), "left_anti")
    repeated = classes.where("n_links > 0").groupBy("_i", "_k").count().where("count > 1")
    if not repeated.isEmpty():
        left = left.withColumn("_key", key).dropDuplicates([i, "_key"]).drop("_key")
    return left.toDF(*docs.columns)
