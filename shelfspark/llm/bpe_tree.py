"""Operator 7: BPE encoding and decoding by tree concatenation.

A text that BPE cannot cut is halved again and again; leaves are encoded on
their own, and two neighbours are joined by encoding a window of ``k`` tokens
on each side of the seam once more, ``k`` doubling until the first and the last
token of the window agree with the tokens that each side had.  A BPE encoding
is right exactly if every pair of neighbouring tokens is; the pairs outside the
window were right before, those inside are right as the library made them, and
agreement at both rims makes the two pairs at the rims ones already seen.

The same is done one level up: a long document is cut into rows, encoded by
tasks in parallel, and the pre-tokens at each seam are scanned again in growing
windows until both sides' boundaries agree.  A pre-token that stands open on both
sides of a seam, however many rows it takes, keeps the codes of its parts: they
are joined by windows of tokens as above, and only those windows are encoded.

Defined results: null text is the empty text, which has no tokens; repeated
rows each give their own row; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, id_text, place, text_blocks, texts_of
from .tokenizing import Codec, WordCache, as_bytes, codec, default_path

VOCABULARY = "byte_bpe_50k.json"
#: Symbols in a leaf of the tree inside one pre-token.
LEAF = 256
#: Characters of a document in one row; longer ones are cut into several.
ROW_CHARS = 32_768
#: Bytes of text that a task works on at once, and so of each Arrow batch it returns.
BATCH_BYTES = 4 << 20
#: A boundary this far from an open end cannot change with what follows.
MARGIN = 32


def _encode(model, s: str) -> tuple[list[int], list[int]]:
    toks = model.tokenize(s)
    return [t.id for t in toks], [len(t.value) for t in toks]


def join(model, s: str, left, right):
    """Codes of ``s`` from those of its two parts."""
    (li, ln), (ri, rn) = left, right
    seam, k = sum(ln), 1
    while True:
        kl, kr = min(k, len(li)), min(k, len(ri))
        a, b = seam - sum(ln[len(ln) - kl :]), seam + sum(rn[:kr])
        wi, wn = _encode(model, s[a:b])
        agree_left = kl == len(li) or (wi[0], wn[0]) == (li[-kl], ln[-kl])
        agree_right = kr == len(ri) or (wi[-1], wn[-1]) == (ri[kr - 1], rn[kr - 1])
        if agree_left and agree_right:
            return li[: len(li) - kl] + wi + ri[kr:], ln[: len(ln) - kl] + wn + rn[kr:]
        k *= 2


def join_codes(path: str, left: bytes, right: bytes) -> tuple[bytes, int]:
    """Codes of an unsplit string from those of its two parts, and how many symbols
    were encoded again."""
    model, tokens = codec(path).model, _token_texts(path)
    li, ri, k, again = memoryview(left).cast("I"), memoryview(right).cast("I"), 1, 0
    while True:
        kl, kr = min(k, len(li)), min(k, len(ri))
        window = "".join(map(tokens.__getitem__, [*li[len(li) - kl :], *ri[:kr]]))
        new = [t.id for t in model.tokenize(window)]
        again += len(window)
        if (kl == len(li) or new[0] == li[-kl]) and (kr == len(ri) or new[-1] == ri[kr - 1]):
            return left[: 4 * (len(li) - kl)] + as_bytes(new) + right[4 * kr :], again
        k *= 2


def tree_encode(model, s: str, leaf: int = LEAF):
    """(ids, symbols in each) of one unsplit string by tree concatenation."""
    level = [_encode(model, s[i : i + leaf]) for i in range(0, len(s), leaf)]
    spans = [s[i : i + leaf] for i in range(0, len(s), leaf)]
    while len(level) > 1:
        out, texts = [], []
        for i in range(0, len(level) - 1, 2):
            both = spans[i] + spans[i + 1]
            out.append(join(model, both, level[i], level[i + 1]))
            texts.append(both)
        if len(level) % 2:
            out.append(level[-1])
            texts.append(spans[-1])
        level, spans = out, texts
    return level[0] if level else ([], [])


@lru_cache(maxsize=4)
def _word_codes(path: str, leaf: int) -> WordCache:
    c = codec(path)

    def make(word: str) -> bytes:
        s = c.mapped(word)
        return as_bytes(c.word_ids(word) if len(s) <= leaf else tree_encode(c.model, s, leaf)[0])

    return WordCache(make)


def scan(c: Codec, text: str) -> list[str]:
    """Pre-tokens and special strings, which together are the text."""
    return [w for part, sp in c.parts(text) for w in ([part] if sp is not None else c.words(part))]


def codes(path: str, leaf: int, words: list[str]) -> list[bytes]:
    c, known = codec(path), _word_codes(path, leaf)
    if any(w in c.special for w in words):
        return [as_bytes([c.special[w]]) if w in c.special else known[w] for w in words]
    return list(map(known.__getitem__, words))


@dataclass
class Scanned:
    """A stretch of text with its pre-tokens: where each ends in the text and in
    the ids, so that only those near a seam ever become objects."""

    text: str
    ends: np.ndarray
    cuts: np.ndarray
    ids: bytes

    @classmethod
    def of(cls, path: str, leaf: int, text: str) -> Scanned:
        words = scan(codec(path), text)
        made = codes(path, leaf, words)
        return cls(text, _sums(map(len, words)), _sums(len(x) // 4 for x in made), b"".join(made))

    def __len__(self) -> int:
        return len(self.ends)

    def start(self, i: int) -> tuple[int, int]:
        """Where pre-token ``i`` begins in the text and in the ids."""
        return (int(self.ends[i - 1]), int(self.cuts[i - 1])) if i else (0, 0)


def _sums(sizes) -> np.ndarray:
    return np.cumsum(np.fromiter(sizes, dtype=np.int64))


def join_scans(path: str, leaf: int, left: Scanned, right: Scanned) -> Scanned:
    """Two neighbouring stretches as one.

    Pre-tokens are found from left to right, so both scans agree for good from
    the first boundary that they share.  The window begins at a boundary of the
    left scan and is scanned again; its boundaries are looked for in the right
    scan, and if none is there, the window grows."""
    if not len(left) or not len(right):
        return left if len(left) else right
    c, k, seam = codec(path), 4, len(left.text)
    while True:
        kl, kr = min(k, len(left)), min(k, len(right))
        k *= 2
        first, first_id = left.start(len(left) - kl)
        if first and seam - first < MARGIN:
            continue
        last = int(right.ends[kr - 1])
        window = scan(c, left.text[first:] + right.text[:last])
        limit = last if kr == len(right) else last - MARGIN
        rims = {0: 0, **{int(e): j + 1 for j, e in enumerate(right.ends[:kr])}}
        at, stop = first - seam, None
        for i, w in enumerate(window):
            if at >= 0 and at in rims and at <= limit:
                stop = i, rims[at]
                break
            at += len(w)
        if stop is None and kr < len(right):
            continue
        i, j = stop or (len(window), kr)  # the window reaches the end: it is right as a whole
        new = _window_codes(path, leaf, window[:i], first - seam, left, right)
        head, at_id = len(left) - kl, right.start(j)[1]
        ends = _sums(map(len, window[:i])) + first
        cuts = _sums(len(x) // 4 for x in new) + first_id
        more = (int(cuts[-1]) if len(cuts) else first_id) - at_id
        return Scanned(
            left.text + right.text,
            np.concatenate([left.ends[:head], ends, right.ends[j:] + seam]),
            np.concatenate([left.cuts[:head], cuts, right.cuts[j:] + more]),
            left.ids[: 4 * first_id] + b"".join(new) + right.ids[4 * at_id :],
        )


def _window_codes(path: str, leaf: int, words: list[str], at: int, left: Scanned, right: Scanned) -> list[bytes]:
    """Codes of the pre-tokens of a window that begins at ``at``, counted from the seam.

    One over the seam whose parts are the last pre-token of the left scan and the
    first of the right one is joined from their codes."""
    ends = _sums(map(len, words)) + at
    i = int(np.searchsorted(ends, 0, side="right"))  # the first word that ends beyond the seam
    if i == len(words) or len(words[i]) <= leaf:
        return codes(path, leaf, words)
    begin, begin_id = left.start(len(left) - 1)
    if int(ends[i]) - len(words[i]) != begin - len(left.text) or int(ends[i]) != int(right.ends[0]):
        return codes(path, leaf, words)
    joined, _ = join_codes(path, left.ids[4 * begin_id :], right.ids[: 4 * int(right.cuts[0])])
    return [*codes(path, leaf, words[:i]), joined, *codes(path, leaf, words[i + 1 :])]


def encode_text(path: str, text: str, leaf: int = LEAF) -> bytes:
    return b"".join(codes(path, leaf, scan(codec(path), text)))


@lru_cache(maxsize=4)
def _token_texts(path: str) -> list[str]:
    """Each token by its id, in the vocabulary's own alphabet."""
    vocab = codec(path).spec["model"]["vocab"]
    table = [""] * (max(vocab.values(), default=-1) + 1)
    for token, i in vocab.items():
        table[i] = token
    return table


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> list[bytes]:
    """The bytes of each token by its id."""
    c = codec(path)
    known = {**c.spec["model"]["vocab"], **c.special}
    table = [b""] * (max(known.values(), default=-1) + 1)
    for token, i in c.spec["model"]["vocab"].items():
        table[i] = c.plain_bytes(token)
    for token, i in c.special.items():
        table[i] = token.encode("utf-8")
    return table


def decode_ids(path: str, ids: bytes) -> str:
    """Tokens' bytes put together; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(_token_bytes(path).__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    leaf: int = LEAF,
    row_chars: int = ROW_CHARS,
    decoded: bool = False,
) -> DataFrame:
    """``id_col`` and ``ids`` (binary, little-endian unsigned 32-bit) of every row;
    with ``decoded`` also the text that the ids decode to, from the same pass."""
    rows = id_text(docs, id_col, text_col)
    id_type = rows.schema["_id"].dataType
    names = ["_id", "ids", "decoded"] if decoded else ["_id", "ids"]

    def columns(file: str, ids: list[bytes]) -> list[pa.Array]:
        out = [pa.array(ids, pa.binary())]
        return [*out, pa.array([decode_ids(file, x) for x in ids], pa.string())] if decoded else out

    def short(it):
        file = path or default_path(VOCABULARY)
        for batch in it:
            for a, texts in text_blocks(batch, BATCH_BYTES):
                ids = [encode_text(file, t, leaf) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("_id").slice(a, len(texts)), *columns(file, ids)], names)

    def pieces(it):
        file = path or default_path(VOCABULARY)
        for whole in it:
            for a in range(0, whole.num_rows, max(1, BATCH_BYTES // (4 * row_chars))):
                batch = whole.slice(a, max(1, BATCH_BYTES // (4 * row_chars)))
                made = [Scanned.of(file, leaf, t) for t in texts_of(batch)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c) for c in ("_doc", "_id", "_seq", "_text")),
                        pa.array([m.ids for m in made], pa.binary()),
                        pa.array([m.ends.astype("<i8").tobytes() for m in made], pa.binary()),
                        pa.array([m.cuts.astype("<i8").tobytes() for m in made], pa.binary()),
                    ],
                    ["_doc", "_id", "_seq", "_text", "ids", "ends", "cuts"],
                )

    def joined(table: pa.Table) -> pa.Table:
        file = path or default_path(VOCABULARY)
        copies = Counter(table.column("_seq").to_pylist())
        rows = table.sort_by("_seq").select(["_seq", "_text", "ids", "ends", "cuts"]).to_pylist()
        level = [
            Scanned(r["_text"], np.frombuffer(r["ends"], "<i8"), np.frombuffer(r["cuts"], "<i8"), r["ids"])
            for i, r in enumerate(rows)
            if not i or r["_seq"] != rows[i - 1]["_seq"]
        ]
        while len(level) > 1:
            level = [
                join_scans(file, leaf, level[i], level[i + 1]) if i + 1 < len(level) else level[i]
                for i in range(0, len(level), 2)
            ]
        ids = [level[0].ids] * copies[0]
        return pa.table(dict(zip(names, [table.column("_id").slice(0, copies[0]), *columns(file, ids)])))

    kind = id_type.simpleString()
    out_schema = f"_id {kind}, ids binary" + ", decoded string" * decoded
    n = F.char_length("_text")
    small = rows.where(n <= row_chars).mapInArrow(short, out_schema)
    big = (
        rows.where(n > row_chars)
        # equal rows meet in one group, which gives as many rows back
        .withColumn("_doc", F.md5(F.concat_ws(":", F.col("_id").cast("string"), F.md5("_text"))))
        # one pass cuts the text, however long it is
        .select("_doc", "_id", F.posexplode(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{row_chars}}}"), F.lit(0))).alias("_seq", "_text"))
        .repartition("_doc", "_seq")
        .mapInArrow(pieces, f"_doc string, _id {kind}, _seq int, _text string, ids binary, ends binary, cuts binary")
        .groupBy("_doc")
        .applyInArrow(joined, out_schema)
    )
    return small.unionByName(big).withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Every row of ``encoded`` with the ``decoded`` text of its ids (null: empty)."""

    def run(it):
        file = path or default_path(VOCABULARY)
        for batch in it:
            texts = [decode_ids(file, x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("ids"), pa.array(texts, pa.string())], ["_id", "ids", "decoded"]
            )

    rows = by_place(encoded).select(F.col(place(encoded, id_col)).alias("_id"), F.col(place(encoded, ids_col)).alias("ids"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, ids binary, decoded string").withColumnRenamed("_id", id_col)
