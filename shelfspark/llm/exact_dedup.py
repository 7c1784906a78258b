"""Exact dedup against a history, by minimal perfect hashes over its digests.

Texts are equal when they are identical after each run of ASCII white space
becomes one space (white space at the ends counts); their SHA-256 stands for
them.  The distinct digests of the history are dealt into parts; each part has a
minimal perfect hash (levels of bits: a key stays on the first level where no
other key has its bit, and its slot is the rank of that bit) and one slot for
each digest with the whole digest and the locator of the winner.  Digests of new
rows are looked up there and compared byte by byte with the slot's digest; the
others are groups of their own.  Rows are aggregated by digest before they are
shuffled, so copies of one text meet nowhere as rows.

Null texts count as empty.  Rows with the smallest id win, null ids come last;
of rows that repeat an id and a text exactly one is kept.  An empty history, an
empty table and columns of any name are allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byteblock import mix
from .common import cut, give_back, id_text

#: White space that is collapsed.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Digests of a part, on average.
PART = 1 << 15
#: Bits of a level for each key that comes to it.
GAMMA = 2
#: Groups with more than one row in so many are joined by broadcast: as many groups at most.
HOT = 4096
#: Columns of a group, and the lists of them in the index.
SLOT, SLOTS = ["digest", "id", "row", "n"], ["digests", "ids", "rows", "counts"]


# --- the minimal perfect hash ---------------------------------------------------


def spots(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place below ``size`` for each key (four 64-bit words), another at each level."""
    h = np.full(len(words), level + 1, dtype=np.uint64)
    for k in range(words.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[:, k])
    return (h % np.uint64(size)).astype(np.int64)


def build_levels(words: np.ndarray) -> list[np.ndarray]:
    """Levels of bits, of which distinct keys set one each."""
    left, levels = np.arange(len(words)), []
    while len(left):
        size = max(GAMMA * len(left), 16)
        at = spots(words[left], len(levels), size)
        count = np.bincount(at, minlength=size)
        levels.append(count == 1)
        left = left[count[at] > 1]
        if len(levels) > 500:
            raise ValueError("keys of a perfect hash have to be distinct")
    return levels


def slots_of(words: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The slot of each key; -1 where a key surely is none of those built in."""
    out, left, base = np.full(len(words), -1, dtype=np.int64), np.arange(len(words)), 0
    for level, bits in enumerate(levels):
        at = spots(words[left], level, len(bits))
        hit = bits[at]
        rank = np.cumsum(bits) - 1
        out[left[hit]] = base + rank[at[hit]]
        left, base = left[~hit], base + int(bits.sum())
    return out


def _words(digests: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(digests.to_pylist()), dtype="<u8").reshape(-1, 4)


# --- digests, index, lookup -----------------------------------------------------


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (a locator, unique in the table), ``id`` and ``digest`` (32 bytes) of each document, written once."""
    text = F.regexp_replace("_text", SPACE_RUN, " ")
    return cut(
        id_text(docs, id_col, text_col).select(
            F.monotonically_increasing_id().alias("row"), F.col("_id").alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")
        )
    )


def _grouped(rows: DataFrame) -> DataFrame:
    """One row for each digest: ``id`` and ``row`` of the winner (the smallest id,
    nulls last, then the locator) and ``n`` rows."""
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("w")
    found = rows.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n"))
    return found.select("digest", F.col("w.id").alias("id"), F.col("w.row").alias("row"), "n")


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int").alias("part")


def n_parts(rows: DataFrame) -> int:
    """Parts for the digests of ``rows``, from the count of rows."""
    return max(1, -(-rows.count() // PART))


def build_index(history: DataFrame, parts: int) -> DataFrame:
    """The index of digest rows: for each part ``levels`` (their bits, packed),
    ``sizes`` (bits of each) and, in slot order, ``digests``, ``ids``, ``rows`` and ``counts``."""
    grouped = _grouped(history).select(_part(parts), *SLOT)
    kinds = [T.IntegerType(), T.ArrayType(T.BinaryType()), T.ArrayType(T.IntegerType())]
    kinds += [T.ArrayType(grouped.schema[c].dataType) for c in SLOT]
    names = ["part", "levels", "sizes", *SLOTS]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def build(key, table):
        words = _words(table.column("digest"))
        levels = build_levels(words)
        table = table.take(pa.array(np.argsort(slots_of(words, levels))))
        heads = [pa.array([key[0].as_py()], pa.int32()), pa.array([[np.packbits(b).tobytes() for b in levels]], pa.list_(pa.binary())), pa.array([[len(b) for b in levels]], pa.list_(pa.int32()))]
        one = pa.array([0, len(table)], pa.int32())
        slots = [pa.ListArray.from_arrays(one, table.column(c).combine_chunks()) for c in SLOT]
        give_back()
        return pa.table([*heads, *slots], names=names)

    return grouped.groupBy("part").applyInArrow(build, schema)


def lookup(index: DataFrame, fresh: DataFrame, parts: int) -> DataFrame:
    """All groups of the history and the new digest rows: ``digest``, ``id`` and
    ``row`` of the winner, ``n`` and ``known`` (the history has the digest)."""
    probes = _grouped(fresh).select(_part(parts), *SLOT)
    schema = T.StructType([*(T.StructField(c, probes.schema[c].dataType) for c in SLOT), T.StructField("known", T.BooleanType())])

    def find(left, right):
        new = right.select(SLOT)
        if not len(left):
            return new.append_column("known", pa.array([False] * len(new), pa.bool_()))
        index = left.combine_chunks()
        slots = pa.table([index.column(c).chunk(0).flatten() for c in SLOTS], names=SLOT)
        sizes, levels = index.column("sizes")[0].as_py(), index.column("levels")[0].as_py()
        bits = [np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool) for b, n in zip(levels, sizes, strict=True)]
        keys, held = _words(new.column("digest")), _words(slots.column("digest"))
        at = slots_of(keys, bits)
        member = at >= 0
        member[member] = (held[at[member]] == keys[member]).all(axis=1)  # all 32 bytes
        repeats, at = new.filter(pa.array(member)), at[member]
        count = slots.column("n").to_numpy().copy()
        count[at] += repeats.column("n").to_numpy()
        ids, rows = slots.column("id").to_pylist(), slots.column("row").to_pylist()
        for i, ident, row in zip(at.tolist(), repeats.column("id").to_pylist(), repeats.column("row").to_pylist(), strict=True):
            if ident is not None and (ids[i] is None or (ident, row) < (ids[i], rows[i])):
                ids[i], rows[i] = ident, row
        old = [slots.column("digest"), pa.array(ids, slots.column("id").type), pa.array(rows, pa.int64()), pa.array(count), pa.array([True] * len(slots), pa.bool_())]
        old = pa.table(old, names=[*SLOT, "known"])
        other = new.filter(pa.array(~member))  # groups of their own
        other = other.append_column("known", pa.array([False] * len(other), pa.bool_()))
        give_back()
        return pa.concat_tables([old, other.cast(old.schema)])

    return index.groupBy("part").cogroup(probes.groupBy("part")).applyInArrow(find, schema)


def decide(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """For each digest row what :func:`exact_dedup` returns.  Groups that hold
    more than one row in ``HOT`` (fewer than ``HOT``, so they are broadcast) do
    not pass through the shuffle."""
    groups = cut(groups.select("digest", F.col("id").alias("keep_id"), F.col("row").alias("keep_row"), "n", "known"))
    least = rows.count() / HOT
    hot, rest = groups.where(F.col("n") > least), groups.where(F.col("n") <= least)
    marked = rows.join(F.broadcast(hot), "digest", "left")
    names = ["row", "id", "digest", "keep_id", "keep_row", "n", "known"]
    done = marked.where("n IS NOT NULL").select(names)
    joined = marked.where("n IS NULL").select("row", "id", "digest").join(rest, "digest").select(names)
    return done.unionAll(joined).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "known",
    )


def exact_dedup(docs: DataFrame, history_to=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id`` (of the row that stays),
    ``group_size``, ``kept``, ``text_sha256`` and ``known`` (a text of the history).

    The history is the rows whose id is at most ``history_to``; left out, it is
    the lower half of the range of (numeric) ids.  Which rows are history decides
    only how a group is found, not the result (but for ``known``).
    """
    rows = digest_rows(docs, id_col, text_col)
    if history_to is None:
        low, high = rows.agg(F.min("id"), F.max("id")).first()
        history_to = low if low is None else low + (high - low) // 2
    old = F.coalesce(F.col("id") <= F.lit(history_to), F.lit(False))
    parts = n_parts(rows)
    index = cut(build_index(rows.where(old), parts))
    return decide(rows, lookup(index, rows.where(~old), parts))
