"""Operators 11, 12 and 13 against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from helpers import collect, frame, rows
from pyspark.sql import functions as F

from shelfspark.llm import exact_dedup, filter_audit, source_audit

# --- 13: exact dedup -----------------------------------------------------------------


def plain_dedup(data):
    """Counter of (id, keep id, size, kept, digest)."""
    digest = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for _, t in data]
    groups = defaultdict(list)
    for (ident, _), d in zip(data, digest, strict=True):
        groups[d].append(ident)
    out = Counter()
    for d, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        out.update((x, ids[0], len(ids), at == 0, d) for at, x in enumerate(ids))
    return out


def copies():
    out = rows(n=30)
    out += [(200 + i, "one  two\tthree") for i in range(40)] + [(-5, "a\x0bb"), (7000, "a b"), (7001, " a b"), (None, "a\x0cb"), (None, None)]
    return out + [(300, "x" * 70000), (301, "x" * 70000), (302, "\xa0"), (303, " ")]


@pytest.mark.parametrize("history_to", [None, -100, 100, 250, 10**6])
def test_dedup_equals_plain_whatever_the_history(spark, history_to, monkeypatch):
    monkeypatch.setattr(exact_dedup, "PART", 16)
    monkeypatch.setattr(exact_dedup, "HOT", 8 if history_to else 4096)
    docs = frame(spark, copies()).withColumn("DOC_ID_", F.lit(1)).withColumn("a.b", F.lit(2)).repartition(3)
    got = exact_dedup.exact_dedup(docs, history_to)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in collect(got)) == plain_dedup(copies())
    if history_to == 100:
        old = {hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for i, t in copies() if i is not None and i <= 100}
        assert {r["text_sha256"] for r in collect(got) if r["known"]} == old


def test_dedup_of_nothing_and_of_null_ids(spark):
    assert collect(exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string"))) == []
    data = [(None, "a"), (None, "a"), (None, None)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, "doc_id long, text string"))
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in collect(got)) == plain_dedup(data)


def test_dedup_of_clashing_names_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "x", 1), ("a", "x", 2)], "doc_id string, text string, DOC_ID int")
    got = collect(exact_dedup.exact_dedup(docs, "a"))
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {("a", "a", True), ("b", "a", False)}


@pytest.mark.parametrize("n", [1, 2, 17, 5000])
def test_perfect_hash_is_minimal_and_checks_members(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, (n, 4)).astype(np.uint64)
    keys[:, :3] = 7  # keys that differ in one word only
    keys[:, 3] = np.arange(n)
    levels = exact_dedup.build_levels(keys)
    assert sorted(exact_dedup.slots_of(keys, levels)) == list(range(n))
    other = keys.copy()
    other[:, 0] = 8
    assert exact_dedup.slots_of(other, levels).max() < n
    with pytest.raises(ValueError):
        exact_dedup.build_levels(np.concatenate([keys, keys[:1]]))


# --- 12: filters ---------------------------------------------------------------------


def plain_filters(data, labels):
    """Rows by part, order and step, by applying the filters to lists of documents."""
    least = {}
    for ident, text, _ in data:
        if ident is not None:
            least[text or ""] = min(ident, least.get(text or "", ident))
    docs = []
    for ident, text, source in data:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": ident is not None and ident > least[t],
        }
        good = any(q == 1 for i, q, _ in labels if i is not None and i == ident)
        toxic = any(x == 1 for i, _, x in labels if i is not None and i == ident)
        docs.append((source or "", {f for f, x in fails.items() if x}, good, toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                gone = len([d for d in mine if f in d[1]]) - len(here)
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(here)
                out[part, "".join(order), step] = (len(left), len(here), gone, sum(d[1] == {f} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filters_equal_plain(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["Ab", "CD", "%", "#x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 150, 230, 300]))) for _ in range(40)]
    texts += [" ".join(rng.choice(words[:60]) for _ in range(250)) for _ in range(10)]
    data = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    data += [(100 + i, texts[0], ["s0", "s1", None][i % 3]) for i in range(60)] + [(-1, texts[5], "s2"), (3, texts[3], "s1"), (3, texts[3], "s1"), (None, texts[0], "s0")]
    data += [(i, t, "odd") for i, t in rows(n=5)] + [(500, "A" * 100_000, ""), (501, None, None), (502, "", "s0")]
    labels = [(i, i % 2, (i % 5 == 0) * 1) for i in range(0, 130)] + [(1, 1, None), (1, 0, 1), (None, 1, 1), (7, None, None)]
    want = plain_filters(data, labels)
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").select("*", F.lit("x").alias("DOC_ID"), F.lit(1).alias("mask"), F.lit(1).alias("a.b"))
    named = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").select("*", F.lit(1).alias("QUALITY"), F.lit(1).alias("n"))
    for parts, held in ((1, 1 << 24), (7, 100)):  # one and many partitions, combined at once and hardly
        monkeypatch.setattr(filter_audit, "HELD", held)
        got = collect(filter_audit.audit_filters(docs.repartition(parts), named))
        assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got} == want
        assert len(got) == len(want)


def test_filters_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert collect(filter_audit.audit_filters(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))) == []


def test_chains_tell_texts_of_one_fingerprint_apart():
    rows_ = [(9, 3, "a", "s"), (9, 1, "b", "s"), (9, 2, "a", "t"), (9, 5, "b", "s"), (9, 1, "b", "u"), (8, 4, "c", "s")]
    for cut in range(len(rows_) + 1):
        routed = list(filter_audit.route(rows_[:cut])) + list(filter_audit.route(rows_[cut:]))
        got = Counter()
        for ident, source, mask, n in filter_audit.resolve(sorted(routed, key=lambda x: x[0])):
            got[ident, source, bool(mask & filter_audit.REPEAT)] += n
        assert got == {(3, "s", True): 1, (2, "t", False): 1, (1, "s", False): 1, (1, "u", False): 1, (5, "s", True): 1, (4, "s", False): 1}


# --- 11: sources ---------------------------------------------------------------------


def plain_sources(data, least_docs):
    """Rows of both parts, term by term in exact integers."""
    terms = [[t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")] for text, _, _ in data]
    out = []
    for lang in {d[1] or "" for d in data}:
        mine = [(t, d[2] or "") for t, d in zip(terms, data, strict=True) if (d[1] or "") == lang]
        docs = Counter(w for t, _ in mine for w in set(t))
        kept = sorted(w for w, n in docs.items() if n >= least_docs)
        sources = sorted({s for _, s in mine}, key=lambda s: s.encode())
        count = {s: Counter(w for t, x in mine if x == s for w in t if docs[w] >= least_docs) for s in sources}
        whole = sum(count.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept))

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        for s in sources:
            pair = [(sum(f(p(count[s], w), p(count[o], w)) for w in kept), o) for o in sources if o != s]
            term = [(f(p(count[s], w), p(whole, w)), w) for w in kept if count[s][w] and p(count[s], w) > p(whole, w)]
            for part, found in (("pair", pair), ("term", term)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                found = found if part == "pair" else found[:10]
                out += [(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(found, 1)]
    return Counter(out)


def spoken():
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "xyzé" for b in ("a", "B", "c", "dd", "日", "ffff")] + [f"rare{chr(97 + i)}" for i in range(20)]
    out = []
    for i in range(150):
        source = rng.choice(["s1", "s1", "s1", "s2", "S", "ß", "𝔘"])
        some = words if source != "S" else words[:9]
        out.append((" ".join(rng.choice(some) for _ in range(rng.randint(0, 30))) + "-UPPER upper1Upper", rng.choice(["en", "en", "en", "de"]), source))
    out += [(None, None, None), ("", "en", "empty"), ("lonely words", "fr", "s1"), ("other", "fr", "s2"), ("x" * 3000 + " ya" * 9000, "en", "s2"), ("123 \x00", "en", None)]
    return out + [("same same", "one", "only")] * 12


def test_sources_equal_plain(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "EXPANDED", 50)
    monkeypatch.setattr(source_audit, "SLICE", 500)
    data = spoken()
    docs = spark.createDataFrame(data, "text string, lang string, source string").select("*", F.lit("no").alias("TEXT"), F.lit("no").alias("term"), F.lit(1).alias("a.b"))
    for least_docs, shard in ((3, 10), (10, 1 << 18)):
        got = Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in collect(source_audit.audit_sources(docs.repartition(3), least_docs=least_docs, shard=shard)))
        assert got == plain_sources(data, least_docs)


def test_sources_of_nothing(spark):
    assert collect(source_audit.audit_sources(spark.createDataFrame([], "text string, lang string, source string"))) == []


def test_term_search_stops_early_and_keeps_ties():
    rng = np.random.default_rng(3)
    c = np.minimum(rng.zipf(1.3, 20_000), 10**6).astype(np.int64)
    d = int(c.sum()) + 2 * len(c)
    q = np.maximum(source_audit.probability((c * rng.uniform(0.5, 30, len(c))).astype(np.int64), 20 * d), 1)
    names = [f"t{i}" for i in range(len(c))]
    found, seen = source_audit.best_terms(c, q, names, d)
    p = source_audit.probability(c, d)
    want = sorted(((int((x - y) ** 2 // (x + y)), n) for x, y, n in zip(p.tolist(), q.tolist(), names, strict=True) if x > y), key=lambda x: (-x[0], x[1]))[:10]
    assert found == want and seen < len(c) / 4
    same = source_audit.best_terms(np.full(30, 5), np.full(30, 2), [f"n{i:02}" for i in range(30)], 100)[0]
    assert [n for _, n in same] == [f"n{i:02}" for i in range(10)]


def test_probabilities_do_not_overflow():
    for c, d in ((0, 2), (9 * 10**14, 9 * 10**15), (8_999_999_999_999_997, 9 * 10**15), (12345678901234, 98765432109876)):
        assert int(source_audit.probability(np.array([c]), np.array([d]))[0]) == 1 + 10**9 * (c + 2) // d
