"""How five filters interact, in every order in which they could run.

Each document gets a mask of the filters that it fails.  Four depend on its text
alone; the fifth fails documents whose text stands under a smaller id anywhere.
For that the texts are routed by their xxhash to the partitions of an RDD, which
sorts (and spills) by fingerprint; a fingerprint's chain holds each different
text once, with the smallest id so far, and every id that is not the smallest is
sent on at once.  Copies within a partition are combined before they are routed,
and what is decided there travels by its id, so a large group of copies reaches
no task whole.  Masks are counted by source in vectors that ``combineByKey``
merges, and the 120 orders are evaluated on those vectors.

Null texts count as empty, null sources as the empty string.  A null id is not
smaller than any other and fails no comparison; rows that repeat the smallest id
all stay.  A document without labels is neither good nor toxic; of repeated
labels any that says 1 counts.  An empty table has no parts and no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_place, cut, give_back, place

#: The filters in the order of their bits, and what they count.
FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
REPEAT = 1 << FILTERS.index("E")
#: Bytes of text that a task holds to combine copies before they are routed, and of a partition that they are routed to.
HELD, ROUTED = 1 << 24, 1 << 25


def text_mask(text: str) -> int:
    """The filters that a text fails by itself."""
    raw = text.encode("utf-8")
    words = raw.split()  # of bytes: just the six ASCII white space characters
    n = len(words)
    capitals = len(raw) - len(raw.translate(None, UPPER))
    marked = len(raw) != len(raw.translate(None, SYMBOLS))
    fails = (n < 200, 100 * len(set(words)) < 50 * n, 100 * capitals > 2 * len(text), marked)
    return sum(1 << i for i, f in enumerate(fails) if f)


class Chains:
    """Different texts, each with its mask, its smallest id so far and the sources of the rows with that id."""

    def __init__(self) -> None:
        self.held: dict[str, list] = {}
        self.bytes = 0

    def add(self, text: str, mask: int, ident, sources: dict[str, int]) -> tuple | None:
        """Take a row; what is no longer smallest comes back as (id, mask, sources)."""
        got = self.held.get(text)
        if got is None:
            self.held[text] = [mask, ident, sources]
            self.bytes += len(text) + 200
            return None
        if ident == got[1]:
            got[2] = {k: got[2].get(k, 0) + sources.get(k, 0) for k in got[2] | sources}
            return None
        if ident > got[1]:
            return ident, mask | REPEAT, sources
        out = got[1], mask | REPEAT, got[2]
        got[1], got[2] = ident, sources
        return out


def route(rows: Iterable) -> Iterator[tuple]:
    """(fingerprint, (text, mask, id, sources)) of each different text of a part of
    the rows; ids already known not to be smallest come without text, under their
    place in the part, so that they spread evenly."""
    chains: dict[int, Chains] = {}
    held = at = 0

    def flush():
        for fp, chain in chains.items():
            for text, (mask, ident, sources) in chain.held.items():
                yield fp, (text, mask, ident, sources)
        chains.clear()

    for row in rows:
        at += 1
        fp, ident, text, source = row
        chain = chains.setdefault(fp, Chains())
        copy = chain.held.get(text)
        mask = copy[0] if copy else text_mask(text)
        if ident is None:
            yield at, (None, mask, None, {source: 1})
            continue
        was = chain.bytes
        out = chain.add(text, mask, ident, {source: 1})
        if out:
            ident, mask, sources = out
            yield at, (None, mask, ident, sources)
        held += chain.bytes - was
        if held > HELD:
            yield from flush()
            held = 0
    yield from flush()
    give_back()


def resolve(routed: Iterable) -> Iterator[tuple]:
    """(id, source, mask, rows) of a partition sorted by fingerprint: one chain is held at a time."""
    now, chain = None, Chains()

    def rows(ident, mask, sources):
        return ((ident, source, mask, n) for source, n in sources.items())

    def smallest():
        for mask, ident, sources in chain.held.values():
            yield from rows(ident, mask, sources)

    for fp, (text, mask, ident, sources) in routed:
        if text is None:
            yield from rows(ident, mask, sources)
            continue
        if fp != now:
            yield from smallest()
            now, chain = fp, Chains()
        out = chain.add(text, mask, ident, sources)
        if out:
            yield from rows(*out)
    yield from smallest()
    give_back()


def failure_masks(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """``id``, ``source``, ``mask`` (bit i: fails filter i) and ``n``, the rows that agree in all of them."""
    text = F.coalesce(F.col(place(docs, text_col)).cast("string"), F.lit(""))
    source = F.coalesce(F.col(place(docs, source_col)).cast("string"), F.lit(""))
    d = by_place(docs)
    id_type = d.schema[place(docs, id_col)].dataType
    size = d.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(size // ROUTED + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    read = d.select(F.xxhash64(text).alias("fp"), F.col(place(docs, id_col)).alias("id"), text.alias("text"), source.alias("source")).rdd
    sent = read.mapPartitions(route).repartitionAndSortWithinPartitions(parts, partitionFunc=int)
    schema = T.StructType(
        [T.StructField("id", id_type), T.StructField("source", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())]
    )
    out = docs.sparkSession.createDataFrame(sent.mapPartitions(resolve), schema, verifySchema=False)
    return out.groupBy("id", "source", "mask").agg(F.sum("n").alias("n"))


def _with_labels(masks: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    named = by_place(labels).select(
        F.col(place(labels, id_col)).alias("id"),
        (F.col(place(labels, "quality")) == 1).alias("good"),
        (F.col(place(labels, "toxic")) == 1).alias("toxic"),
    )
    named = named.where("id IS NOT NULL AND (good OR toxic)").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))

    def flag(name: str):
        return F.coalesce(F.col(name), F.lit(False)).cast("int").alias(name)

    return masks.join(named, "id", "left").select("source", "mask", "n", flag("good"), flag("toxic"))


def _count(vector: list[int], row: tuple) -> list[int]:
    mask, n, good, toxic = row
    vector[mask] += n
    vector[32 + mask] += n * good
    vector[64 + mask] += n * toxic
    return vector


def _merge(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def all_orders(part: str, vector: list[int]) -> Iterator[tuple]:
    """The rows of a part for every order and step, from its counts by mask."""
    count, good, toxic = vector[:32], vector[32:64], vector[64:]
    removed_by = dict.fromkeys(range(5), 0)
    out = []
    for order in permutations(range(5)):
        before = 0
        for step, f in enumerate(order, 1):
            bit = 1 << f
            here = [m for m in range(32) if m & bit and not m & before]
            removed = sum(count[m] for m in here)
            removed_by[f] += removed
            redundant = sum(count[m] for m in range(32) if m & bit and m & before)
            before |= bit
            kept = sum(count[m] for m in range(32) if not m & before)
            out.append((order, step, f, kept, removed, redundant, count[bit], sum(good[m] for m in here), sum(toxic[m] for m in here)))
    for order, step, f, *numbers in out:
        yield (part, "".join(FILTERS[i] for i in order), step, *numbers, removed_by[f])


ORDERS_SCHEMA = (
    "part string, filter_order string, step int, kept long, removed long, redundant long,"
    " unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def audit_filters(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", source_col="source") -> DataFrame:
    """One row for each source, order of the filters and step: ``part``,
    ``filter_order``, ``step``, ``kept``, ``removed``, ``redundant``,
    ``unique_fails``, ``good_lost``, ``toxic_lost``, ``shapley``."""
    masks = _with_labels(cut(failure_masks(docs, id_col, text_col, source_col)), labels, id_col)
    pairs = masks.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4])))
    vectors = pairs.combineByKey(lambda row: _count([0] * 96, row), _count, _merge)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: all_orders(*kv)), ORDERS_SCHEMA, verifySchema=False)
