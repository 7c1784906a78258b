"""Operators 2, 3, 6 and 10 and the pipeline against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import collect, frame, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from shelfspark.llm import byteblock, jaccard_join, knn_kdtree, quality_classifier, quality_rules, queries, sharding
from shelfspark.llm.byteblock import Block
from shelfspark.llm.components import components

# --- 2: near copies ----------------------------------------------------------------


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_classes(data):
    """Counter of (id, class, links), by comparing all pairs."""
    s = [shingles(t) for _, t in data]
    n = len(data)
    root, links = list(range(n)), [0] * n

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if s[i] and s[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(n):
        members[find(i)].append(data[i][0])
    least = {r: min((x for x in m if x is not None), default=None) for r, m in members.items()}
    return Counter((data[i][0], least[find(i)] if links[i] else data[i][0], links[i]) for i in range(n))


def near_copies(seed=5):
    """Families of edited copies, a large one among them, beside the awkward rows."""
    rng = random.Random(seed)
    out, ident = list(rows(n=20)), 1000
    for size in (2, 3, 5, 90):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 160))]
        for _ in range(size):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            out.append((ident, " ".join(w)))
            ident += 1
        out += [(ident, " ".join(words)), (ident + 1, " ".join(words))]
        ident += 2
    rng.shuffle(out)
    return out


def got_classes(df, **kw):
    return Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in collect(jaccard_join.jaccard_classes(df, **kw)))


def test_classes_equal_all_pairs(spark, monkeypatch):
    data = near_copies()
    want = plain_classes(data)
    assert got_classes(frame(spark, data)) == want
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 16)  # the large family in several blocks
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    assert got_classes(frame(spark, data)) == want


def test_classes_of_nothing(spark):
    assert jaccard_join.jaccard_classes(frame(spark, [], extra=False)).count() == 0
    assert got_classes(frame(spark, [(1, None), (2, ""), (3, " \n")])) == Counter({(1, 1, 0): 1, (2, 2, 0): 1, (3, 3, 0): 1})


def test_keep_one_of_each_class(spark):
    data = near_copies()
    df = frame(spark, data)
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    got = Counter(r["doc_id"] for r in collect(kept))
    want = Counter()
    for (i, c, links), n in plain_classes(data).items():
        if i == c:
            want[i] += 1 if links else n
    assert got == want


def test_depth_reaches_the_recall():
    """At the shortest prefix hardly any pair at the threshold is lost, one value more would lose some."""
    for similarity in (0.8, 0.5, 0.95):
        d = jaccard_join.floor_depth(similarity)
        assert d == 1 or jaccard_join.meets(similarity, d) >= jaccard_join.RECALL
        assert d == jaccard_join.DEPTH or jaccard_join.meets(similarity, d + 1) < 0.999999


def test_recall_is_estimated_from_the_links_found():
    rng = np.random.default_rng(5)
    edge = 0.8 + 0.2 * np.arange(jaccard_join.BINS) / jaccard_join.BINS
    there = rng.integers(2000, 4000, jaccard_join.BINS)
    for depth in (8, 6):
        found = rng.binomial(there, jaccard_join.meets(edge, depth))
        got = jaccard_join.recall_at(found, 0.8, depth)
        assert abs(got - found.sum() / there.sum()) < 0.005
        then = rng.binomial(there, jaccard_join.meets(edge, 5)).sum() / there.sum()
        assert abs(jaccard_join.recall_at(found, 0.8, depth, 5) - then) < 0.005


def depths_of(spark, data):
    from shelfspark.llm.common import id_text

    texts = id_text(frame(spark, data, extra=False), "doc_id", "text")
    signed = jaccard_join.signatures(texts, "bigint", jaccard_join.TREES, 5).where("sig is not null")
    distinct = signed.groupBy("key").agg(F.min("_id").alias("first_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    links, depths = jaccard_join.all_links(texts, distinct.cache(), "bigint", jaccard_join.SIMILARITY, 5, jaccard_join.TREES, jaccard_join.RECALL)
    return depths, links.count()


def test_prefixes_are_shortened_as_far_as_the_data_ask(spark):
    rng = random.Random(8)
    alike, edge = [], []
    for f in range(700):
        words = [f"v{rng.randrange(10**9)}" for _ in range(100)]
        one = [*words, "tail"]  # an index of 96/97
        alike += [(f, " ".join(words)), (10000 + f, " ".join(one))]
        some = [*words[:90], *(f"n{rng.randrange(10**9)}" for _ in range(10))]  # about 0.81
        edge += [(f, " ".join(words)), (10000 + f, " ".join(some))]
    depths, links = depths_of(spark, alike)
    assert depths[0] == jaccard_join.DEPTH and depths[-1] >= 5 and links == 1400
    depths, links = depths_of(spark, edge)
    assert depths[-1] < 5 and links == 1400


def test_neighbours_in_sorted_tries(spark, monkeypatch):
    """Every prefix that two documents share in a tree is seen from both of them."""
    rng = np.random.default_rng(2)
    sigs = [rng.integers(0, 3, (2, jaccard_join.DEPTH)).astype("<u2") for _ in range(200)]
    rows_ = [(i.to_bytes(2, "big"), bytearray(s.tobytes()), 1) for i, s in enumerate(sigs)]
    df = spark.createDataFrame(rows_, "key binary, sig binary, size long").repartition(3)
    got = {(r["tree"], int.from_bytes(bytes(r["key"]), "big")): r["depth"] for r in collect(jaccard_join.trie(df, 2, 1))}
    exact = 0
    for t in range(2):
        for i in range(200):
            most = max(int(np.cumprod(sigs[i][t] == sigs[j][t]).sum()) for j in range(200) if j != i)
            assert got.get((t, i), 0) >= most
            exact += got.get((t, i), 0) == most
    assert exact >= 400 - 20  # but for rows at the rims of partitions


def test_recall_of_the_forest():
    """Pairs at the threshold meet in some tree as often as promised."""
    rng = random.Random(3)
    met = total = 0
    for _ in range(40):
        texts = []
        base = [f"t{rng.randrange(10**9)}" for _ in range(90)]
        for _ in range(2):
            texts.append(" ".join(base))
            base = base[:80] + [f"u{rng.randrange(10**9)}" for _ in range(10)]
        a, b = (shingles(t) for t in texts)
        assert 0.76 < len(a & b) / len(a | b) < 0.86
        blk = Block(texts)
        _, sig = jaccard_join.minima(*jaccard_join.shingles(blk), jaccard_join.TREES)
        p = jaccard_join.prefix_codes(sig, jaccard_join.floor_depth(0.8))
        met += bool((p[0] == p[1]).any())
        total += 1
    assert met / total >= 0.99


def test_links_of_a_hub(spark, monkeypatch):
    """A hub of near copies in many blocks: every pair is looked at once."""
    rng = random.Random(6)
    words = [f"h{i}" for i in range(120)]
    data = []
    for i in range(400):
        w = list(words)
        w[rng.randrange(120)] = f"e{i}"
        data.append((i, " ".join(w)))
    want = plain_classes(data)
    monkeypatch.setattr(jaccard_join, "BLOCK_BYTES", 40 * 116 * 8)  # blocks by bytes: ten of forty
    assert got_classes(frame(spark, data, extra=False)) == want


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components_equal_union_find(spark, pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r["node"]: r["root"] for r in collect(components(spark.createDataFrame(pairs, "u long, v long")))}
    assert got == {x: find(x) for x in root if find(x) != x}


# --- 3 and 8: quality -----------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark, medium):
    return spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")


def auc(score, label):
    up, down = score[label == 1], score[label == 0]
    return float(((up[:, None] > down[None, :]) + 0.5 * (up[:, None] == down[None, :])).mean())


def test_classifier_on_held_out_rows(spark, medium, labelled):
    got = {r["doc_id"]: r for r in collect(queries.op3_quality_classifier(spark, medium))}
    assert len(got) == labelled[0].count()
    y = {r["doc_id"]: r["quality"] for r in collect(labelled[1])}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [i for i in y if got[i]["held_out"]]
    score, label = np.array([got[i]["score"] for i in held]), np.array([y[i] for i in held])
    assert auc(score, label) > 0.95
    assert ((score >= 0.5) == label).mean() > 0.93


def test_rules_on_held_out_rows(spark, medium, labelled):
    got = {r["doc_id"]: r for r in collect(queries.op8_quality_rules(spark, medium))}
    y = {r["doc_id"]: r["quality"] for r in collect(labelled[1])}
    held = [i for i in y if zlib.crc32(str(i).encode()) % 3 == 1]
    p, label = np.array([got[i]["probability"] for i in held]), np.array([y[i] for i in held])
    assert auc(p, label) > 0.95
    kept = np.array([got[i]["kept"] for i in held])
    assert kept[label == 1].mean() > 0.97 and kept[label == 0].mean() < 0.3


def test_models_without_labels(spark):
    docs, none = frame(spark, rows()), spark.createDataFrame([], "doc_id long, quality int")
    model = quality_classifier.fit(docs, none)
    got = collect(quality_classifier.score_quality(docs, model))
    assert len(got) == len(rows()) and {r["score"] for r in got} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    assert {r["score"] for r in collect(quality_classifier.score_quality(docs, quality_classifier.fit(docs, one)))} == {1.0}
    assert quality_rules.fit(docs, one).weights is None
    assert quality_classifier.score_quality(frame(spark, [], extra=False), model).count() == 0
    kept = quality_classifier.filter_quality(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count()


M64 = (1 << 64) - 1


def plain_mix(h):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * m & M64
    return h ^ (h >> 33)


def plain_hash(word):
    """Pieces of eight bytes, each mixed by itself and with its number, and the length."""
    h = len(word) * 0xD1B54A32D192ED03
    for k in range(0, len(word), 8):
        h += plain_mix((plain_mix(int.from_bytes(word[k : k + 8], "little")) + (k // 8 + 1) * byteblock.PRIME) & M64)
    return plain_mix(h & M64)


def plain_slots(text):
    """Slots of word runs of one and two and of byte runs of three and four."""
    data = text.encode()
    words = [plain_hash(w) for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    for n in (1, 2):
        for i in range(len(words) - n + 1):
            h = 0
            for w in words[i : i + n]:
                h = (h * byteblock.PRIME + w) & M64
            yield (plain_mix(h) * (2 * n + 1) & M64) >> 32 & ((1 << quality_rules.BITS) - 1)
    for n in (3, 4):
        for i in range(len(data) - n + 1):
            h = 0
            for k in range(n):
                h = (h ^ data[i + k]) * quality_rules.ODD[k] & 0xFFFFFFFF
                h ^= h >> 15
            yield h >> (32 - quality_rules.BITS)


TEXTS = ["", " ", "a", "one two three", "one two three one two three one two three", "x\ny\nx\n\nx", "The cat, THE CAT! 12 [a]", "éclair würde 日本語 𝔘 $$ <b>", "ab " * 300]


def test_margins_and_shares_equal_plain_ones():
    rng = np.random.default_rng(0)
    weights = rng.normal(0, 1, 1 << quality_rules.BITS).astype(np.float32)
    got = quality_rules.margins(Block(TEXTS), weights)
    for t, m, (slots, shares) in zip(TEXTS, got, quality_rules.sparse(Block(TEXTS))):
        want = list(plain_slots(t))
        assert abs(m - (quality_rules.SCALE * float(weights[want].astype(float).mean()) if want else 0)) < 1e-4
        c = Counter(want)
        assert slots.tolist() == sorted(c) and np.allclose(shares, [c[k] / len(want) for k in sorted(c)])


def test_descent_lowers_the_loss_and_calibration_is_its_optimum():
    rng = np.random.default_rng(1)
    cols = [np.sort(rng.choice(50, 12, replace=False)).astype(np.int32) for _ in range(200)]
    vals = [np.full(12, 1 / 12, np.float32) for _ in range(200)]
    true = rng.normal(0, 3, 50)
    z = np.array([true[c].sum() / 2 for c in cols])
    y = (rng.random(200) < 1 / (1 + np.exp(-z))).astype(float)

    def loss(w, b):
        m = np.array([quality_rules.SCALE * (w[c] * v).sum() + b for c, v in zip(cols, vals)])
        return np.mean(np.logaddexp(0, m) - y * m) + 5e-5 * (w**2).sum()

    before = loss(np.zeros(1 << quality_rules.BITS), 0.0)
    w, b = quality_rules._descend(cols, vals, y, 80)
    assert loss(w, b) < 0.75 * before and loss(w, b) <= loss(w, b + 0.5) and loss(w, b) <= loss(w * 0.5, b)
    a, c = quality_rules._platt(z, y)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (200 - y.sum() + 2))

    def cost(a, c):
        m = a * z + c
        return np.sum(np.logaddexp(0, m) - target * m) + 5e-4 * ((a - 1) ** 2 + c**2)

    assert all(cost(a, c) <= cost(a + da, c + dc) for da, dc in ((0.02, 0), (-0.02, 0), (0, 0.02), (0, -0.02)))


def plain_statistics(t):
    data, n = t.encode(), max(len(t.encode()), 1)
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    m = max(len(words), 1)
    kinds = [rb"[a-z]", rb"[A-Z]", rb"[0-9]", rb"[#*$%&|<>]", rb"[.,;:?]", rb"!", rb"[-_/\\=+~^@\"'()\[\]{}]", rb"\n"]
    out = [len(re.findall(k, data)) / n for k in kinds]
    out[7] = min(out[7] * 20, 3)
    size = [min(len(w), 64) for w in words]
    mean = sum(size) / m
    out += [mean / 8, max(sum(x * x for x in size) / m - mean**2, 0) ** 0.5 / 6]
    out.append((len(words) - len(set(words))) / m)
    out.append(sum(a == b for a, b in zip(words, words[1:])) / m * 2)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    out.append(len(covered) / m * 2)
    out.append(sum(bool(re.search(rb"[#*$%&|<>]", w)) for w in words) / m * 2)
    out.append(sum(65 <= w[0] <= 90 for w in words) / m)
    seen, twice, lines = set(), 0, data.split(b"\n")
    for line in lines:
        if re.search(rb"[^\x20\x09-\x0D]", line):
            twice += line in seen
            seen.add(line)
    return [*out, twice / len(lines), np.log1p(len(words)) / 8]


def test_statistics_equal_plain_ones():
    texts = [*TEXTS, *[t or "" for _, t in rows(n=10)]]
    assert np.allclose(quality_classifier.statistics(Block(texts)), [plain_statistics(t) for t in texts], atol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-5, 5), st.integers(0, 1)), min_size=1, max_size=40))
def test_isotonic_curve_is_the_best_monotone_one(points):
    s, y = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    xs, ys = quality_classifier.isotonic(s, y)
    # the best monotone fit of the means of equal scores, by its max-min formula
    u = np.unique(s)
    total, n = np.array([y[s == v].sum() for v in u]), np.array([(s == v).sum() for v in u])
    best = [max(min(total[a : e + 1].sum() / n[a : e + 1].sum() for e in range(i, len(u))) for a in range(i + 1)) for i in range(len(u))]
    assert np.allclose(ys, np.unique(np.round(best, 12)))
    assert (np.diff(ys) > 0).all() and (np.diff(xs) >= 0).all()
    assert abs((ys * 1).sum()) <= len(ys) and ys.min() >= 0 and ys.max() <= 1


def test_gaussian_kernel_is_approximated():
    x = np.random.default_rng(0).normal(0, 0.2, (20, quality_classifier.N_STATS))
    z = quality_classifier.lift(x, quality_classifier.fourier(features=20000))[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-d * quality_classifier.WIDTH**2 / 2)).max() < 0.05


# --- 6: shards -------------------------------------------------------------------------------


def check_shards(data, got, shards):
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in data)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_of_awkward_rows(spark):
    data = rows()
    check_shards(data, collect(sharding.interleave(frame(spark, data))), 24)
    assert sharding.interleave(frame(spark, [], extra=False)).count() == 0


def test_shards_do_not_depend_on_the_ranges(spark, monkeypatch):
    data = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 5}") for i in range(2000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("a.b", F.lit(1)).select("*", F.lit(1).alias("TEXT"))
    want = {(r["doc_id"], r["shard"], r["slot"]) for r in collect(sharding.interleave(df))}
    monkeypatch.setattr(sharding, "RANGE_ROWS", 1)
    monkeypatch.setattr(sharding, "HASH_BITS", 1)
    assert sharding.range_bits(2000, 1) == 11
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in collect(sharding.interleave(df))} == want
    monkeypatch.setattr(sharding, "RANGE_ROWS", 1 << 30)
    monkeypatch.setattr(sharding, "RANGE_BITS", 0)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in collect(sharding.interleave(df))} == want


def test_every_shard_has_the_mixture(spark):
    data = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = collect(sharding.interleave(df, shards=10))
    check_shards(data, got, 10)
    source = {i: s for i, _, s in data}
    share = Counter(source.values())
    for s in range(10):
        here = Counter(source[r["doc_id"]] for r in got if r["shard"] == s)
        assert all(abs(here[k] - n / 10) <= 2 for k, n in share.items())
    again = collect(sharding.interleave(df.repartition(7), shards=10))
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in got) == Counter((r["doc_id"], r["shard"], r["slot"]) for r in again)


# --- 10: nearest vectors ------------------------------------------------------------------------


def plain_top(vectors, k=5, every=50):
    def whole(v):
        return [min(max(int(np.floor(256 * float(x))), -(2**63)), 2**63 - 1) for x in v]

    fine = [(i, whole(v)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v in fine:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        scored = sorted((-max(min(sum(a * b for a, b in zip(v, w)), 2**63 - 1), -(2**63)), i) for i, w in fine if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return Counter(out)


@pytest.mark.parametrize("scale, seed", [(1.0, 1), (0.01, 2), (1e12, 3)])
def test_top_k_equals_all_scores(spark, scale, seed):
    rng = np.random.default_rng(seed)
    vectors = [(i, [float(np.float32(x)) for x in rng.normal(0, scale, 6)]) for i in range(400)]
    vectors += [(1000 + i, vectors[7][1]) for i in range(60)] + [(7, vectors[7][1]), (None, vectors[0][1]), (2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 6), (2003, [float("inf")])]
    vectors += [(2050, [0.5, 0.25]), (2100, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).withColumn("shard", F.lit("y"))
    got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collect(knn_kdtree.top_k(df, shard_rows=64, cells=8)))
    assert got == plain_top([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in vectors])


def test_queries_go_only_to_cells_that_can_hold_an_answer(spark):
    """Far clusters: after the first visit hardly a box reaches the k-th score, and
    the other cells are asked only where one does."""
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 30, (16, 3))
    points = [(i, (centres[i % 16] + rng.normal(0, 0.2, 3)).tolist()) for i in range(1600)]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    asked = []
    real = knn_kdtree.visits

    def spy(*a):
        out = real(*a)
        asked.append(out)
        return out

    knn_kdtree.visits = spy
    try:
        got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collect(knn_kdtree.top_k(df, shard_rows=50, cells=16)))
        first, others = (x.count() for x in asked)
    finally:
        knn_kdtree.visits = real
    assert got == plain_top(points)
    queries_ = 1600 // 50
    assert first <= 4 * queries_  # the shards of one cell
    assert others <= 4 * queries_  # of fifteen other cells with two shards or more each


def test_cells_split_ties_and_skew():
    rows_ = np.repeat([[0.0, 1.0], [0.0, 2.0], [5.0, 1.0]], [50, 3, 3], axis=0)
    cuts = knn_kdtree.Cuts.of(rows_, 8)
    cell = cuts.cells_of(rows_)
    assert len(set(cell.tolist())) == 3 and len({(c, *r) for c, r in zip(cell.tolist(), rows_.tolist())}) == 3
    assert knn_kdtree.Cuts.of(np.zeros((0, 2)), 4).cells_of(rows_).tolist() == [0] * 56


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    assert Counter((r["query_id"], r["rank"], r["vec_id"]) for r in collect(knn_kdtree.top_k(df))) == Counter([(0, 1, 50), (50, 1, 0)])
    assert knn_kdtree.top_k(df.limit(0)).count() == 0


# --- the pipeline ----------------------------------------------------------------------------------


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    # what the models keep of the whole table, by the operators' own scores
    kept_by = {
        "quality_classifier": {r["doc_id"] for r in collect(queries.op3_quality_classifier(spark, small)) if r["predicted"]},
        "quality_rules": {r["doc_id"] for r in collect(queries.op8_quality_rules(spark, small)) if r["kept"]},
    }
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in collect(docs)}
        out = stage(spark, docs, small)
        if name in kept_by:
            assert {r["doc_id"] for r in collect(out)} == kept_by[name] & set(before)
        if name == corpus_pipeline.STAGES[-1][0]:
            got = collect(out)
            assert {r["doc_id"] for r in got} == set(before)
            break
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in collect(docs)}
        assert set(after) <= set(before)
        if name == "jaccard_join":
            classes = plain_classes(list(before.items()))
            assert set(after) == {i for i, c, _ in classes if i == c}
        if name == "secret_scan":
            assert set(after) == set(before)
        else:
            assert all(before[i] == t for i, t in after.items())
    tokens = Counter({r["doc_id"]: r["doc_tokens"] for r in got})  # pieces differ with the partitions, documents do not
    assert Counter({r["doc_id"]: r["doc_tokens"] for r in collect(corpus_pipeline.run(spark, small))}) == tokens


def thue_morse(n):
    """A word over a and b and its complement, which many hashes cannot tell apart."""
    w = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_words_that_cancel_in_polynomials_are_told_apart(spark, n):
    a, b = thue_morse(n)
    texts = [f"{a}\n{b}", " ".join([a] * 5 + [b] * 5), f"{a}\n{a}\n{b}", " ".join([b] * 10)]
    blk = Block(texts)
    assert blk.duplicate_lines().tolist() == [0, 0, 1, 0]
    assert blk.repeated_words().tolist() == [0, 0, 0, 10]
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b}"), (4, f"{b} {a}")], "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"], r["n_links"]) for r in collect(jaccard_join.jaccard_classes(docs))} == {(i, i, 0) for i in (1, 2, 3, 4)}


def test_counts_stay_right_when_all_hashes_are_alike(monkeypatch):
    texts = ["a b c d e f a b c d e", "x\ny\nx\n\nx", "one two three four five six seven", "", "a b c d e"]
    want = Block(texts).repeated_words().tolist(), Block(texts).duplicate_lines().tolist()
    assert want == ([10, 0, 0, 0, 0], [0, 2, 0, 0, 0])
    monkeypatch.setattr(Block, "hashes", lambda self, start, end: np.zeros(len(start), np.uint64))
    assert (Block(texts).repeated_words().tolist(), Block(texts).duplicate_lines().tolist()) == want


def test_fits_with_clashing_names_repeated_ids_and_any_partitions(spark):
    rng = random.Random(6)
    good, bad = "the people of the town met in the hall and spoke".split(), "$$ ## buy now click % free *** win".split()
    data = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randint(20, 60)))) for i in range(120)]
    data += [(i, f"another text of the same id {i}") for i in range(0, 120, 3)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "`a.b` long, quality int").select("*", F.lit("x").alias("QUALITY"), F.lit(3).alias("_id"))
    docs = spark.createDataFrame(data, "`a.b` long, text string").select("*", F.lit(1).alias("A.B"), F.lit("t").alias("TEXT"), F.lit(0).alias("quality"), F.lit(9).alias("_label"))
    for module, score in ((quality_classifier, quality_classifier.score_quality), (quality_rules, quality_rules.apply_rules)):
        found = []
        for parts in (1, 7):
            model = module.fit(docs.repartition(parts), labels.repartition(parts), id_col="a.b")
            out = score(docs, model, id_col="a.b")
            found.append(sorted((r["a.b"], r["score" if "score" in r else "probability"]) for r in collect(out)))
        assert [x for x, _ in found[0]] == [x for x, _ in found[1]]
        assert np.allclose([y for _, y in found[0]], [y for _, y in found[1]], atol=1e-6)


@pytest.mark.parametrize("doc_kind, label_kind", [("string", "long"), ("long", "string"), ("string", "string")])
def test_labels_meet_documents_of_another_kind_of_id(spark, doc_kind, label_kind):
    """Text that is no number meets no number; it is no error."""
    from shelfspark.llm.labelled import sample

    odd = ["0-17", "", "12.5", "99999999999999999999", None]
    docs = [(str(i), f"text {i}") for i in range(30)] + [(i, "odd") for i in odd if doc_kind == "string"]
    labels = [(str(i), i % 2) for i in range(30)] + [(i, 1) for i in odd if label_kind == "string" != doc_kind]
    docs = spark.createDataFrame(docs, "doc_id string, text string").withColumn("doc_id", F.col("doc_id").cast(doc_kind))
    labels = spark.createDataFrame(labels, "doc_id string, quality int").withColumn("doc_id", F.col("doc_id").cast(label_kind))
    got = sorted((str(r["_id"]), r["_text"], r["_label"]) for r in sample(docs, labels, 100, "s").collect())
    assert got == sorted((str(i), f"text {i}", float(i % 2)) for i in range(30) if zlib.crc32(str(i).encode()) % 3 != 1)
