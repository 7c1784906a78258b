"""Operator 1: secret scans through a trigram inverted index, JVM side only.

From each rule's expression the trigrams that a match must hold are derived as
a Boolean query.  The index keeps, by trigram and segment of rows, the sorted
list of the rows that hold it (of just the trigrams that some rule asks for).
A query intersects and unites these lists segment by segment; only the texts of
the rows that are left meet the expression.  A rule without mandatory trigrams
(hexadecimal runs) scans every text.

A segment has about ``SEGMENT_ROWS`` rows, so no list grows with the table.  Lists
name a row by a hash of its text, which equal texts share; results are joined
back by id and hash, once for each row.  Places of matches are running sums of
the lengths of the matches and of the pieces between them, taken by doubling
steps, so a text with n matches costs n log n.

Defined results: null is the empty text, without spans; repeated rows each give
a row; spans are code points, end exclusive; extra columns are not read, and
``redact`` passes them on whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_place, cut, id_text, place
from .trigrams import query_of, thin, trigrams_of

#: Candidate rows (three numbers each) that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Rows in one segment of the index, about.
SEGMENT_ROWS = 4096
#: Code points in one chunk of a text that is cut up for redaction.
CHUNK = 512


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # whose length counts
    at_least: int = 0
    base: bool = False


#: A line of base64; engines bound nested repetition, so runs of lines are written in parts.
_LINES = r"(?:[\x20\t\r\n\\]+[A-Za-z0-9+/=]{16,})"

#: The rules of the contract first, in its order, then our own.
RULES = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
        True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18, True),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, True),  # maximal runs; shorter ones fail anyway
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[0-9A-Za-z-]{10,}"),
    # with its body: all up to the END line, or where that is missing the header and base64 lines
    Rule(
        "pem",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
        r"(?:(?:[^-]+-{1,4}){0,40}[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----"
        r"|(?:[\x20\t\r\n\\]+[A-Z][A-Za-z]{1,20}-[A-Z][A-Za-z]{1,20}:[^\r\n]{0,200}){0,4}"
        + _LINES
        + r"{1,60}"
        + (_LINES + r"{0,60}") * 17
        + r"(?:[\x20\t\r\n\\]+[A-Za-z0-9+/]{1,15}={0,2}[\x20\t]*(?:[\r\n]|$))?)?",
    ),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("basic", r"[a-z][a-z0-9+]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, merge) -> Column:
    """The array of ``merge`` over the first 1, 2, ... values, by doubling steps;
    ``values`` is a lambda variable."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30)]), lambda w: w < F.size(values))

    def double(p: Column, w: Column) -> Column:
        moved = F.concat(F.array_repeat(F.lit(None).cast("int"), w), F.slice(p, F.lit(1), F.size(p) - w))
        return F.zip_with(p, moved, lambda a, b: F.when(b.isNull(), a).otherwise(merge(a, b)))

    return F.aggregate(steps, values, double)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, ord, end) of a rule's matches, from the lengths of the
    matches and of the pieces between them."""
    pieces = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        lambda b, m: F.struct(F.char_length(b).alias("before"), F.char_length(m).alias("size"), F.char_length(m).alias("counts")),
    )
    if rule.group:
        pieces = F.zip_with(
            pieces,
            F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)),
            lambda p, g: F.struct(p["before"].alias("before"), p["size"].alias("size"), F.char_length(g).alias("counts")),
        )

    def spans(z: Column, ends: Column) -> Column:
        # the last piece stands after all matches
        wanted = F.filter(
            F.zip_with(z, ends, lambda p, e: F.struct(p["size"].alias("size"), p["counts"].alias("counts"), e.alias("end"))),
            lambda s: s["size"].isNotNull() & (s["counts"] >= rule.at_least),
        )
        return F.transform(wanted, lambda s: F.struct((s["end"] - s["size"]).alias("start"), F.lit(order).alias("ord"), s["end"].alias("end")))

    def placed(z: Column) -> Column:
        upto = F.transform(z, lambda p: p["before"] + F.coalesce(p["size"], F.lit(0)))
        return let(upto, lambda u: spans(z, running(u, lambda a, b: a + b)))

    return let(pieces, placed)


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).withColumn("_hash", F.xxhash64("_text"))


def _queries(rules) -> dict[int, object]:
    return {i: thin(q) for i, r in enumerate(rules) if (q := query_of(r.pattern)) is not True}


def wanted_trigrams(rules=RULES) -> list[str]:
    return sorted({t for q in _queries(rules).values() for t in trigrams_of(q)})


def index(named: DataFrame, trigrams: list[str], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The postings: ``tri`` (place in ``trigrams``), ``seg`` and ``rows``, the sorted
    ``_hash`` of the rows of that segment whose text, case folded, holds the trigram."""
    segments = max(1, -(-named.count() // segment_rows))
    low = named.select("_hash", F.lower("_text").alias("_low"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(trigrams)])
    found = F.transform(F.filter(wanted, lambda w: F.contains(F.col("_low"), w["t"])), lambda w: w["i"])
    return (
        low.select("_hash", F.explode(found).alias("tri"))
        .groupBy("tri", F.pmod("_hash", F.lit(segments)).alias("seg"))
        .agg(F.sort_array(F.collect_set("_hash")).alias("rows"))
    )


def _lookup(query, bits: dict[str, int]) -> Column:
    """Rows of one segment that satisfy a query, from its ``lists`` by trigram."""
    if isinstance(query, str):
        return F.coalesce(F.element_at("lists", F.lit(bits[query])), F.array().cast("array<bigint>"))
    parts = [_lookup(q, bits) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def candidates(named: DataFrame, rules=RULES, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Texts whose postings satisfy some rule's query: ``_hash`` and ``hit_<i>``."""
    queries, trigrams = _queries(rules), wanted_trigrams(rules)
    if not queries:
        return named.select("_hash").limit(0)
    bits = {t: i for i, t in enumerate(trigrams)}
    # a segment has one list for each trigram of the rules
    lists = index(named, trigrams, segment_rows).groupBy("seg").agg(F.map_from_entries(F.collect_list(F.struct("tri", "rows"))).alias("lists"))

    def named_by(i: int):
        return lambda h: F.struct(h.alias("h"), F.lit(i).alias("i"))

    rows = F.concat(*[F.transform(_lookup(q, bits), named_by(i)) for i, q in queries.items()])
    return (
        lists.select(F.explode(rows).alias("x"))
        .groupBy(F.col("x.h").alias("_hash"))
        .agg(*[F.max(F.col("x.i") == i).alias(f"hit_{i}") for i in queries])
    )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """``id_col``, ``_hash`` (of the text) and ``spans``: sorted array of
    (start, ord, end), ``ord`` being the rule's place in ``rules``."""
    named = _named(docs, id_col, text_col)
    indexed = list(_queries(rules))
    everywhere = [i for i in range(len(rules)) if i not in indexed]
    none = F.array().cast("array<struct<start:int,ord:int,end:int>>")
    full = named.select("_id", "_hash", F.concat(*[spans_of(F.col("_text"), rules[i], i) for i in everywhere], none).alias("_full"))
    found = cut(candidates(named, rules))
    side = found.withColumnRenamed("_hash", "_chash")
    matched = named.join(
        F.broadcast(side) if found.count() <= BROADCAST_ROWS else side.hint("merge"),
        F.col("_hash") == F.col("_chash"),
    )
    # exploded, so that spans are found once a row; equal rows share their spans
    verified = (
        matched.select(
            F.col("_id").alias("_cid"),
            "_chash",
            F.explode(F.concat(*[F.when(F.col(f"hit_{i}"), spans_of(F.col("_text"), rules[i], i)).otherwise(none) for i in indexed], none)).alias("s"),
        )
        .groupBy("_cid", "_chash")
        .agg(F.collect_set("s").alias("_some"))
    )
    both = full.join(verified, (F.col("_hash") == F.col("_chash")) & F.col("_id").eqNullSafe(F.col("_cid")), "left")
    spans = F.sort_array(F.concat("_full", F.coalesce("_some", none)))
    return both.select(F.col("_id").alias(id_col), "_hash", spans.alias("spans"))


def label(spans: Column, rules=RULES) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def without(text: Column, spans: Column, mark: str, chunk: int = CHUNK) -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``.

    The text is cut into chunks once, and what stands between spans is put
    together from those, so no span is sought from the text's start."""
    end_of_text = F.char_length(text)

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        """Characters ``a`` to ``b`` of the text."""
        first = F.floor(a / chunk).cast("int")
        few = F.array_join(F.slice(chunks, first + 1, F.floor((b - 1) / chunk).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(few, a - first * chunk + 1, b - a)).otherwise("")

    def gaps(s: Column, upto: Column) -> Column:
        """Stretches before each run of spans and after the last one."""
        before = F.concat(F.array(F.lit(0)), upto)
        starts = F.concat(F.transform(s, lambda x: x["start"]), F.array(end_of_text))
        both = F.zip_with(before, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        n = F.size(s)
        fresh = F.filter(F.transform(both, lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), i.alias("i"))), lambda x: (x["b"] >= x["a"]) | (x["i"] == n))
        return F.transform(fresh, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))

    def put(chunks: Column) -> Column:
        ends = F.transform(spans, lambda x: x["end"])
        return let(ends, lambda e: F.array_join(F.transform(gaps(spans, running(e, F.greatest)), lambda g: piece(chunks, g["a"], g["b"])), mark))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)), put)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]", rules=RULES) -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``;
    all other columns stay as they are."""
    found = cut(scan_secrets(docs, id_col, text_col, rules).where(F.size("spans") > 0).dropDuplicates(["_hash", id_col]))
    few = found.count() <= BROADCAST_ROWS
    side = found.toDF("_cid", "_chash", "_spans")
    rows, i, t = by_place(docs), place(docs, id_col), place(docs, text_col)
    joined = rows.join(
        F.broadcast(side) if few else side.hint("merge"),
        (F.xxhash64(F.coalesce(F.col(t).cast("string"), F.lit(""))) == F.col("_chash")) & F.col(i).eqNullSafe(F.col("_cid")),
        "left",
    )
    clean = F.when(F.col("_spans").isNull(), F.col(t)).otherwise(without(F.col(t), F.col("_spans"), mark))
    return joined.select(*[clean.alias(c) if c == t else F.col(c) for c in rows.columns]).toDF(*docs.columns)
