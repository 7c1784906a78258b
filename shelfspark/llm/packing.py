"""Operator 4: vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.
Bins are filled one by one; of the waiting pieces that fit, the one whose demand
vector has the largest dot product with the bin's remaining capacity goes in,
each dimension weighted by the mean demand of what waits.  When nothing fits any
more, one piece is cut so that its head fills the bin exactly.  Texts longer
than a sequence first give whole sequences of their own.

Each task packs the rows it reads, through a pool of bounded size, so nothing is
shuffled and memory does not depend on the input.  The last bin of a task is split
into powers of two, which need no padding; so is, for plain documents, a bin that
the limit of segments closes before it is full.

Defined results: null text is the empty text (its document is the end mark
alone); repeated rows are packed each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import by_place, id_text, place, text_blocks
from .tokenizing import as_bytes, default_path, encode_bytes

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
MAX_TOKENS = 2048
MAX_SEGMENTS = 256
#: In plain documents every token bears loss, so this equals the token limit.
MAX_LOSS = 2048
#: Pieces that wait at most; packing starts when so many do and stops at half.
POOL = 1024


@dataclass
class Piece:
    doc: object
    start: int
    ids: bytes
    doc_tokens: int
    loss: np.ndarray | None = None  # running count of loss-bearing tokens, from 0; None: all bear loss

    def __len__(self) -> int:
        return len(self.ids) // 4

    @property
    def n_loss(self) -> int:
        return len(self) if self.loss is None else int(self.loss[-1] - self.loss[0])

    def cut(self, n: int) -> tuple[Piece, Piece]:
        a, b = (None, None) if self.loss is None else (self.loss[: n + 1], self.loss[n:])
        return (
            Piece(self.doc, self.start, self.ids[: 4 * n], self.doc_tokens, a),
            Piece(self.doc, self.start + n, self.ids[4 * n :], self.doc_tokens, b),
        )

    def room(self, tokens: int, loss: int) -> int:
        """Tokens of the longest head within both limits."""
        n = min(tokens, len(self))
        if self.loss is not None:
            n = min(n, int(np.searchsorted(self.loss, self.loss[0] + loss, side="right")) - 1)
            return n
        return min(n, loss)


@dataclass
class Packer:
    """Packs a stream of pieces; ``emit`` gets one list of pieces for a sequence."""

    max_tokens: int = MAX_TOKENS
    max_segments: int = MAX_SEGMENTS
    max_loss: int = MAX_LOSS
    pool: int = POOL
    powers: bool = False  # what other limits keep from filling a bin goes out as powers of two
    waiting: list[Piece] = field(default_factory=list)

    def add(self, piece: Piece):
        while (n := piece.room(self.max_tokens, self.max_loss)) < len(piece):
            if n == 0:
                raise ValueError("a token needs more loss than a sequence holds")
            head, piece = piece.cut(n)
            yield [head]
        if len(piece) == self.max_tokens:
            yield [piece]
        elif len(piece):
            self.waiting.append(piece)
            if len(self.waiting) >= self.pool:
                yield from self.pack(self.pool // 2)

    def pack(self, leave: int):
        """Fill bins until at most ``leave`` pieces wait."""
        cap = np.array([self.max_tokens, self.max_segments, self.max_loss], dtype=float)
        pieces = self.waiting
        size = np.array([[len(p), 1, p.n_loss] for p in pieces], dtype=float).reshape(len(pieces), 3)
        free = np.ones(len(pieces), dtype=bool)
        demand = size / cap
        left = len(pieces)
        while left > leave:
            weight = demand[free].mean(axis=0)
            room, bin_ = cap.copy(), []
            while left:
                fits = free & (size <= room).all(axis=1)
                if not fits.any():
                    break
                score = demand @ (weight * room / cap)
                i = int(np.argmax(np.where(fits, score, -1.0)))
                # in the last place for a segment a longer piece is cut to fill the bin
                if room[1] == 1 and size[i, 0] < room[0] and (free & (size[:, 0] > room[0])).any():
                    break
                bin_.append(pieces[i])
                free[i] = False
                room -= size[i]
                left -= 1
            if left and room.min() > 0:
                score = np.where(free, demand @ weight, -1.0)
                i = int(np.argmax(score))
                n = pieces[i].room(int(room[0]), int(room[2]))
                if 0 < n < len(pieces[i]):
                    head, rest = pieces[i].cut(n)
                    bin_.append(head)
                    pieces[i] = rest
                    size[i] = len(rest), 1, rest.n_loss
                    demand[i] = size[i] / cap
            yield from self.in_powers(bin_) if self.powers else [bin_]
        self.waiting = [p for p, f in zip(pieces, free) if f]

    def in_powers(self, bin_: list[Piece]):
        """A full bin as it is, another one as parts whose tokens are powers of two."""
        queue, total = list(bin_), sum(map(len, bin_))
        if total == self.max_tokens:
            yield bin_
            return
        while total:
            want = 1 << (total.bit_length() - 1)
            total -= want
            part = []
            while want:
                p = queue.pop(0)
                if len(p) > want:
                    p, rest = p.cut(want)
                    queue.insert(0, rest)
                part.append(p)
                want -= len(p)
            yield part

    def finish(self):
        """Pack what waits; the one sequence that is not full goes out as powers of two."""
        for bin_ in self.pack(0):
            yield from self.in_powers(bin_)


SCHEMA = (
    "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, n_loss long"
)
NAMES = ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "n_loss"]


def _rows(sequences, base: int, id_type: pa.DataType, most: int = 4 << 20):
    """Record batches of about ``most`` bytes of ids."""
    cols: list[list] = [[] for _ in NAMES]
    size, seq = 0, base
    for sequence in sequences:
        at = 0
        for p in sequence:
            for col, v in zip(cols, (p.doc, p.start, len(p), p.ids, p.doc_tokens, seq, at, p.n_loss)):
                col.append(v)
            at += len(p)
            size += len(p.ids)
        seq += 1
        if size >= most:
            yield _batch(cols, id_type)
            cols, size = [[] for _ in NAMES], 0
    if cols[0]:
        yield _batch(cols, id_type)


def _batch(cols, id_type) -> pa.RecordBatch:
    kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], NAMES)


def pack_examples(examples: DataFrame, pieces_of, columns: list[str], id_col: str, **limits) -> DataFrame:
    """Pack what ``pieces_of(batch)`` makes of each Arrow batch of ``columns``.

    ``limits``: ``max_tokens``, ``max_segments``, ``max_loss``, ``pool``, ``powers``.
    Sequence ids are unique, not consecutive: task number times 2**32, counted on.
    """
    kind = examples.schema[id_col].dataType.simpleString()

    def run(it):
        packer, seen = Packer(**limits), [None]

        def sequences():
            for batch in it:
                seen[0] = batch.schema.field(id_col).type
                for piece in pieces_of(batch):
                    yield from packer.add(piece)
            yield from packer.finish()

        out = sequences()
        first = next(out, None)
        if first is None:
            return

        def again():
            yield first
            yield from out

        yield from _rows(again(), TaskContext.get().partitionId() << 32, seen[0])

    return examples.select(*columns).mapInArrow(run, f"_id {kind}, {SCHEMA}").withColumnRenamed("_id", id_col)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str | None = None,
    end_id: int = END_ID,
    **limits,
) -> DataFrame:
    """Every document's ids and the end mark, cut into pieces and packed."""
    end = as_bytes([end_id])

    def pieces(batch):
        file = path or default_path(VOCABULARY)
        for a, texts in text_blocks(batch, 4 << 20):
            for doc, text in zip(batch.column("_id").slice(a, len(texts)).to_pylist(), texts):
                ids = encode_bytes(file, text) + end
                yield Piece(doc, 0, ids, len(ids) // 4)

    out = pack_examples(id_text(docs, id_col, text_col), pieces, ["_id", "_text"], "_id", powers=True, **limits)
    return out.withColumnRenamed("_id", id_col)


def pack_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
    path: str | None = None,
    end_id: int = END_ID,
    **limits,
) -> DataFrame:
    """Instruction data: a conversation is one example, its turns in order, each
    with the end mark; only tokens of ``loss_role`` bear loss."""
    from pyspark.sql import functions as F

    end = as_bytes([end_id])
    conv, turn, role, text = (F.col(place(turns, c)) for c in (conv_col, turn_col, role_col, text_col))
    said = F.struct(turn.alias("n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    examples = by_place(turns).groupBy(conv.alias("_id")).agg(F.sort_array(F.collect_list(said)).alias("turns"))

    def pieces(batch):
        file = path or default_path(VOCABULARY)
        for conv, said in zip(batch.column("_id").to_pylist(), batch.column("turns").to_pylist()):
            ids = [encode_bytes(file, t["text"]) + end for t in said]
            bears = np.concatenate([np.full(len(x) // 4, t["role"] == loss_role) for x, t in zip(ids, said)])
            whole = b"".join(ids)
            yield Piece(conv, 0, whole, len(whole) // 4, np.concatenate([[0], np.cumsum(bears)]))

    return pack_examples(examples, pieces, ["_id", "turns"], "_id", **limits).withColumnRenamed("_id", conv_col)
