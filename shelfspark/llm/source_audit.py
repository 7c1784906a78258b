"""How sources of a language differ in their words, exactly.

Words are counted in tasks that combine copies before the shuffle; a kept term
has one posting list, its counts by source.  The terms of a language are dealt
into shards by hash, so neither a large language nor a large source meets in one
task.  A shard adds up its share of every pair of sources from its postings: for
terms that both have, term by term; for terms that one has, by that source's
counts, each different count once; for all other terms one value holds.  Its best
terms of a source come from buckets of counts: the largest count and the smallest
probability in the language bound every f in a bucket, buckets are evaluated from
the highest bound on, and the search stops once the next bound is strictly below
the tenth value.

Null text, language and source count as empty.  A language without kept terms has
only pairs, of value 0; a source without kept terms takes part with counts of 0.
All arithmetic is on 64-bit integers, which is exact below 9e15 words of a language.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, by_place, cut, give_back, place, text_blocks

#: A term is in so many documents at least; the scale of probabilities; ranks of terms.
LEAST_DOCS, SCALE, RANKS = 10, 1_000_000_000, 10
#: Bytes of a term are ASCII letters (lower-cased) and bytes above ASCII.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Postings of a shard, about; pairs expanded at once; counted terms that a task holds.
SHARD, EXPANDED, HELD = 1 << 18, 1 << 20, 1 << 18
#: Bytes of a text that are split at once.
SLICE = 1 << 20


# --- counting -------------------------------------------------------------------


def _words_of(text: str) -> Iterator[list[bytes]]:
    """Terms of a text in runs, so that a very long text is never one list of words."""
    raw = text.encode("utf-8").translate(TERM_BYTES)
    at = 0
    while at < len(raw):
        end = len(raw) if at + SLICE >= len(raw) else raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and documents of the terms of each group; term '' stands for the group itself."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (count, docs) in groups.items():
            terms = [b"", *count]
            for a, b in blocks([len(t) + 1 for t in terms], SLICE):
                some = terms[a:b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()),
                        pa.array([source] * len(some), pa.string()),
                        pa.array([t.decode("utf-8") for t in some], pa.string()),
                        pa.array([count[t] for t in some], pa.int64()),
                        pa.array([docs[t] for t in some], pa.int64()),
                    ],
                    names=["lang", "source", "term", "c", "docs"],
                )
        groups.clear()

    for batch in batches:
        langs, sources = batch.column("lang").to_pylist(), batch.column("source").to_pylist()
        for first, texts in text_blocks(batch, SLICE, "text"):
            for i, text in enumerate(texts, first):
                count, docs = groups.setdefault((langs[i], sources[i]), (Counter(), Counter()))
                seen: set[bytes] = set()
                for words in _words_of(text):
                    count.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(c) + 1 for c, _ in groups.values()) > HELD:
                yield from flush()
    yield from flush()
    give_back()


def term_counts(docs: DataFrame, text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``c`` and ``docs`` of all terms, and each group under term ''."""

    def column(name: str, alias: str):
        return F.coalesce(F.col(place(docs, name)).cast("string"), F.lit("")).alias(alias)

    read = by_place(docs).select(column(lang_col, "lang"), column(source_col, "source"), column(text_col, "text"))
    counted = read.mapInArrow(_count_terms, "lang string, source string, term string, c long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs"))


def postings(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang``, ``term``, ``c`` (in the language) and ``list`` (its ``source`` and
    ``c``) of terms in at least ``least_docs`` documents; under term '' the groups."""
    listed = counts.groupBy("lang", "term").agg(
        F.sum("c").alias("c"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "c")).alias("list")
    )  # one entry for each source at most
    return listed.where((F.col("term") == "") | (F.col("docs") >= least_docs)).drop("docs")


# --- probabilities --------------------------------------------------------------


def probability(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (c + 2) / d), three decimals at a time, so that no product overflows."""
    rest, out = np.asarray(c, np.int64) + 2, np.int64(0)
    d = np.asarray(d, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // d
        rest = rest % d
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


# --- a shard --------------------------------------------------------------------


def _bucket(c: np.ndarray) -> np.ndarray:
    """Counts in buckets, eight to a doubling; small counts by themselves."""
    top = np.floor(np.log2(np.maximum(c, 1))).astype(np.int64)
    shift = np.maximum(top - 3, 0)
    return (shift << 4) + (c >> shift)


def best_terms(c: np.ndarray, q: np.ndarray, names: list[str], d: int, k: int = RANKS) -> tuple[list[tuple[int, str]], int]:
    """The ``k`` best (f, term) of a group from its counts (above 0) and the
    language's probabilities, best-first by bucket; and how many terms were evaluated."""
    order = np.argsort(_bucket(c), kind="stable")
    c, q = c[order], q[order]
    start = np.flatnonzero(np.diff(_bucket(c), prepend=-1))
    high, low = probability(np.maximum.reduceat(c, start), d), np.minimum.reduceat(q, start)
    bound = np.where(high > low, divergence(high, low), -1)
    end = np.append(start[1:], len(c))
    found: list[tuple[int, str]] = []
    seen = 0
    for b in np.argsort(-bound, kind="stable"):
        if bound[b] < 0 or (len(found) == k and bound[b] < found[-1][0]):
            break
        p, some = probability(c[start[b] : end[b]], d), q[start[b] : end[b]]
        seen += len(some)
        f = np.where(p > some, divergence(p, some), -1)
        if len(found) == k:
            f = np.where(f >= found[-1][0], f, -1)
        hits = np.flatnonzero(f >= 0)
        if len(hits) > k:  # all that tie with the k-th stay
            hits = hits[f[hits] >= np.partition(f[hits], -k)[-k]]
        found += [(int(f[i]), names[order[start[b] + i]]) for i in hits]
        found = sorted(found, key=lambda x: (-x[0], x[1].encode("utf-8")))[:k]
    return found, seen


def pair_sums(term: np.ndarray, source: np.ndarray, c: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shares of sums of f over the terms of a shard (``term`` ascending, one entry
    for each source that has it), without those that neither source has:
    (first source, second source, sum), first below second."""
    zero = probability(np.zeros(len(d), np.int64), d)
    p = probability(c, d[source])
    # terms of one source against the other's probability of no count, each different count once
    key, times = np.unique(np.stack([source, c]), axis=1, return_counts=True)
    edge = np.searchsorted(key[0], np.arange(len(d) + 1))
    for s, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        if a < b:
            ps, n = probability(key[1][a:b], d[s]), times[a:b]
            other = np.delete(np.arange(len(d)), s)
            for some in np.array_split(other, max(1, len(other) * len(ps) // EXPANDED + 1)):
                gain = divergence(ps[:, None], zero[some][None, :]) - divergence(zero[s], zero[some])[None, :]
                yield np.minimum(s, some), np.maximum(s, some), (gain * n[:, None]).sum(axis=0)
    # what changes where both have the term
    first = np.flatnonzero(np.diff(term, prepend=-1))
    after = np.repeat(np.append(first[1:], len(term)), np.diff(np.append(first, len(term)))) - np.arange(len(term)) - 1
    for a, b in blocks(after.tolist(), EXPANDED):  # entries, each with the later ones of its term
        n = after[a:b]
        i = np.repeat(np.arange(a, b), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        if not len(i):
            continue
        g, h = source[i], source[j]
        change = divergence(p[i], p[j]) - divergence(p[i], zero[h]) - divergence(zero[g], p[j]) + divergence(zero[g], zero[h])
        at = np.minimum(g, h) * len(d) + np.maximum(g, h)
        pairs, spot = np.unique(at, return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, spot, change)
        yield pairs // len(d), pairs % len(d), total


_OUT = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("kind", pa.string()), ("value", pa.int64())])


def _shard(key, terms, groups):
    """Pairs' shares and best terms of one shard of a language; ``groups`` are the language's sources."""
    lang, shard = key[0].as_py(), key[1].as_py()
    names = sorted(groups.column("source").to_pylist(), key=lambda s: s.encode("utf-8"))
    by_name = dict(zip(groups.column("source").to_pylist(), groups.column("n").to_pylist(), strict=True))
    v, n_lang = groups.column("v")[0].as_py(), groups.column("n_lang")[0].as_py()
    d = np.array([by_name[s] + 2 * v for s in names], np.int64)
    out: list[tuple] = []
    if shard == 0:  # every pair, as if no source had any term
        zero = probability(np.zeros(len(d), np.int64), d) if v else None
        for g in range(len(names) - 1):
            base = v * divergence(zero[g], zero[g + 1 :]) if v else np.zeros(len(names) - g - 1, np.int64)
            out.append((np.full(len(base), g), np.arange(g + 1, len(names)), base))
    tables = []
    if len(terms):
        terms = terms.combine_chunks()
        lists = terms.column("list").chunk(0)
        number = {s: i for i, s in enumerate(names)}
        size = np.diff(lists.offsets.to_numpy())
        entry = lists.flatten()
        coded = entry.field("source").dictionary_encode()
        source = np.array([number[s] for s in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
        c = entry.field("c").to_numpy()
        term = np.repeat(np.arange(len(terms)), size)
        held = c > 0
        source, c, term = source[held], c[held], term[held]
        out += pair_sums(term, source, c, d)
        q = probability(terms.column("c").to_numpy(), n_lang + 2 * v)
        text = terms.column("term").to_pylist()
        by_source = np.argsort(source, kind="stable")
        for mine in np.split(by_source, np.flatnonzero(np.diff(source[by_source])) + 1):
            s = source[mine[0]]
            found, _ = best_terms(c[mine], q[term[mine]], [text[t] for t in term[mine]], int(d[s]))
            tables.append(pa.table([[lang] * len(found), [names[s]] * len(found), [t for _, t in found], ["term"] * len(found), [f for f, _ in found]], schema=_OUT))
    if out:
        g, h, value = (np.concatenate(x) for x in zip(*out, strict=True))
        at, spot = np.unique(g * len(d) + h, return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, spot, value)
        sources = pa.array(names, pa.string())
        tables.append(
            pa.table(
                [pa.array([lang] * len(at), pa.string()), sources.take(pa.array(at // len(d))), sources.take(pa.array(at % len(d))), pa.array(["pair"] * len(at), pa.string()), pa.array(total)],
                schema=_OUT,
            )
        )
    give_back()
    return pa.concat_tables(tables) if tables else _OUT.empty_table()


def audit_sources(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", least_docs: int = LEAST_DOCS, shard: int = SHARD) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value``,
    ``rank``: each source against each other one of its language, and its ten
    words that exceed the language most."""
    lists = cut(postings(term_counts(docs, text_col, lang_col, source_col), least_docs))
    kept = lists.where("term <> ''")
    entries = kept.select("lang", F.explode("list").alias("e")).select("lang", F.col("e.source").alias("source"), F.col("e.c").alias("n"), F.lit(1).alias("one"))
    found = lists.where("term = ''").select("lang", F.explode("list.source").alias("source"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("one"))
    groups = entries.unionAll(found).groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("one").alias("entries"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n_lang"))
    shards = F.greatest(F.ceil(F.sum("entries").over(Window.partitionBy("lang")) / shard), F.lit(1)).cast("int")
    groups = cut(
        groups.withColumn("shards", shards)
        .join(langs, "lang", "left")
        .select("lang", "source", "n", "shards", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"))
    )
    # languages of several shards: one row for as many postings as a shard has
    ways = groups.where("shards > 1").groupBy("lang").agg(F.first("shards").alias("shards"))
    dealt = kept.join(F.broadcast(ways), "lang", "left").withColumn("shard", F.pmod(F.xxhash64("term"), F.coalesce("shards", F.lit(1))).cast("int")).select("lang", "shard", "term", "c", "list")
    given = groups.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    shares = dealt.groupBy("lang", "shard").cogroup(given.groupBy("lang", "shard")).applyInArrow(_shard, "lang string, a string, b string, kind string, value long")
    shares = cut(shares)
    pairs = shares.where("kind = 'pair'").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = pairs.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    terms = shares.where("kind = 'term'").select("lang", F.col("a").alias("source"), F.lit("term").alias("part"), F.col("b").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).unionAll(terms.withColumn("rank", rank).where(F.col("rank") <= RANKS))
    return ranked.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
