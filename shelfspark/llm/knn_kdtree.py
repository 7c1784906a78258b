"""Operator 10: exact top-k by inner product with a KD-tree in each shard.

The space is first split at medians of a bounded sample into at most ``CELLS``
cells; a cell of many rows is dealt into shards of about ``SHARD_ROWS``.  In each
shard the vectors are split at medians of the widest dimension, each node keeping
the tight box around its vectors.  A query visits nodes best-first by the largest
inner product that any point of the box can have with it, and drops all that
cannot beat its k-th best.  That k-th score is propagated: it starts from a
bounded sample of all rows, goes on from leaf to leaf, and from the cell whose
box promises most, which a query visits first, to the other cells; of these it
visits only the ones whose tight box reaches the k-th score.

Boxes of the cells are the only thing sent to every task: ``CELLS`` times two
corners.  Queries reach the shards in Arrow batches.

Defined results: components are floor(256 x) as 64-bit integers (beyond that
range the nearest end of it, and so are scores); a shorter vector ends in zeros;
rows with a null id or vector, or a null or non-finite component, take no part;
rows with the query's id are the query's own; of queries with one id the
smallest vector counts; candidates that repeat take a rank each.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_place, cut, place

K = 5
EVERY = 50
SCALE = 256
SHARD_ROWS = 4096
LEAF = 128
#: Rows whose scores give each query its first bound; they are sent to every task.
SEEDS = 512
#: Cells of the space at most, and sampled rows for each from which it is split.
CELLS = 256
CELL_SAMPLE = 16
EXACT = float(1 << 53)
TOP = (1 << 63) - 1


def matrix(vectors: list, width: int) -> np.ndarray:
    """Rows padded with zeros; float64 where all products are exact in it, else
    Python integers."""
    out = np.zeros((len(vectors), width), dtype=object)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    if not len(vectors) or max(abs(int(out.min())), abs(int(out.max()))) < 1 << 22:
        return out.astype(np.float64)
    return out


def regular(column: pa.Array) -> np.ndarray | None:
    """The vectors of one length and of moderate size as a matrix, without loops."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = len(column)
    if not n or len(flat) % n or not len(flat):
        return None
    width = len(flat) // n
    if (np.diff(column.offsets.to_numpy()) != width).any() or np.abs(flat).max() >= 1 << 22:
        return None
    return flat.reshape(n, width).astype(np.float64)


def cap(score) -> int:
    """As a 64-bit integer, the nearest end beyond its range."""
    return max(-TOP - 1, min(TOP, int(score)))


class Tree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.lo, self.hi, self.least, self.kids, self.range = [], [], [], [], []
        order = np.arange(len(ids))
        self.v = vectors
        self._build(order, ids, 0, len(ids), leaf)
        self.order = order
        self.ids, self.v = ids[order], vectors[order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _build(self, order, ids, a, b, leaf) -> int:
        rows = self.v[order[a:b]]
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        me = len(self.lo)
        self.lo.append(lo)
        self.hi.append(hi)
        self.least.append(int(ids[order[a:b]].min()))
        self.kids.append(None)
        self.range.append((a, b))
        if b - a > leaf and len(lo) and (hi > lo).any():
            axis = int(np.argmax(hi - lo))
            mid = (a + b) // 2
            order[a:b] = order[a:b][np.argsort(rows[:, axis], kind="stable")]
            self.kids[me] = (self._build(order, ids, a, mid, leaf), self._build(order, ids, mid, b, leaf))
        return me

    def search(self, queries: np.ndarray, own: list[int], best: list[list[tuple[int, int]]], k: int) -> list[list[tuple[int, int]]]:
        """The rows that may be among the k best of each query, as (score, -id).

        ``best`` holds scores already known to exist elsewhere (the propagated
        bound); they only prune and are not returned."""
        if not len(self.ids):
            return [[] for _ in own]
        bounds = np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T
        out = []
        for i, q in enumerate(own):
            floor = best[i][0] if len(best[i]) == k else None
            top: list[tuple[int, int]] = []
            row = bounds[i]
            heap = [(-row[0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                reach = (cap(-bound), -self.least[node])
                if floor is not None and reach < floor or len(top) == k and reach < top[0]:
                    if floor is not None and reach[0] < floor[0] or len(top) == k and reach[0] < top[0][0]:
                        break
                    continue
                if self.kids[node]:
                    for kid in self.kids[node]:
                        heapq.heappush(heap, (-row[kid], kid))
                    continue
                a, b = self.range[node]
                scores = self.v[a:b] @ queries[i]
                low = max(floor[0] if floor is not None else -np.inf, top[0][0] if len(top) == k else -np.inf)
                for j in np.flatnonzero(scores >= low) if low > -np.inf else range(b - a):
                    if (cand := (cap(scores[j]), -int(self.ids[a + j])))[1] == -q or floor is not None and cand < floor:
                        continue
                    if len(top) < k:
                        heapq.heappush(top, cand)
                    elif cand > top[0]:
                        heapq.heapreplace(top, cand)
            out.append(sorted(top, reverse=True))
        return out


def seed_bounds(queries: np.ndarray, own: list[int], seed_ids: np.ndarray, seeds: np.ndarray, k: int):
    """The k best seeds of each query as a heap, the worst first."""
    if not len(seed_ids):
        return [[] for _ in own]
    scores = queries @ seeds.T
    out = []
    for q, row in zip(own, scores):
        near = np.argpartition(-row, min(4 * k, len(row) - 1))[: 4 * k] if row.dtype != object and len(row) > 4 * k else range(len(row))
        best = heapq.nlargest(k, ((cap(row[j]), -int(seed_ids[j])) for j in near if seed_ids[j] != q))
        out.append(best[::-1])
    return out


@dataclass
class Cuts:
    """The split of the space: a node's dimension and value, its kids or its cell."""

    axis: list[int]
    value: list[float]
    kids: list[tuple[int, int] | None]
    cell: list[int]

    @classmethod
    def of(cls, sample: np.ndarray, cells: int) -> Cuts:
        me = cls([], [], [], [])
        me._grow(sample, cells, iter(range(cells)))
        return me

    def _grow(self, rows: np.ndarray, cells: int, numbers) -> int:
        at = len(self.axis)
        self.axis.append(0)
        self.value.append(0.0)
        self.kids.append(None)
        self.cell.append(-1)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(0)
        axis = int(np.argmax(spread)) if len(spread) else 0
        if cells < 2 or len(rows) < 2 or not spread[axis] > 0:
            self.cell[at] = next(numbers)
            return at
        order = np.sort(rows[:, axis])
        middle = order[len(rows) // 2]
        self.axis[at], self.value[at] = axis, middle if middle > order[0] else order[order > middle][0]
        left = rows[:, axis] < self.value[at]
        low = self._grow(rows[left], cells // 2, numbers)
        self.kids[at] = (low, self._grow(rows[~left], cells - cells // 2, numbers))
        return at

    def cells_of(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            at, some = todo.pop()
            if self.kids[at] is None:
                out[some] = self.cell[at]
                continue
            left = rows[some, self.axis[at]] < self.value[at]
            todo += [(self.kids[at][0], some[left]), (self.kids[at][1], some[~left])]
        return out


def rows_of(column: pa.Array, width: int) -> np.ndarray:
    got = regular(column)
    return got if got is not None and got.shape[1] == width else matrix(column.to_pylist(), width)


@dataclass
class Boxes:
    """Tight boxes of the cells and the shards that each is dealt into."""

    cell: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    shards: np.ndarray

    @property
    def first_shard(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.shards)])

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No score of a query in a cell is larger (a little room for rounding)."""
        q = queries.astype(float)
        reach = np.maximum(q, 0) @ self.hi.T + np.minimum(q, 0) @ self.lo.T
        return reach + np.abs(q) @ np.maximum(np.abs(self.lo), np.abs(self.hi)).T * 1e-12 + 1


def _boxes(placed: DataFrame, width: int, shard_rows: int) -> Boxes:
    schema = "cell int, n long, lo array<double>, hi array<double>"

    def emit(kept: dict):
        cells = sorted(kept)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(cells, pa.int32()),
                pa.array([kept[c][0] for c in cells], pa.int64()),
                pa.array([kept[c][1].tolist() for c in cells], pa.list_(pa.float64())),
                pa.array([kept[c][2].tolist() for c in cells], pa.list_(pa.float64())),
            ],
            ["cell", "n", "lo", "hi"],
        )

    def add(kept: dict, cell: int, n: int, lo: np.ndarray, hi: np.ndarray):
        if cell in kept:
            m, a, b = kept[cell]
            n, lo, hi = n + m, np.minimum(a, lo), np.maximum(b, hi)
        kept[cell] = n, lo, hi

    def part(it):
        kept: dict = {}
        for batch in it:
            cell, v = batch.column("cell").to_numpy(zero_copy_only=False), rows_of(batch.column("v"), width).astype(float)
            for c in np.unique(cell):
                mine = v[cell == c]
                add(kept, int(c), len(mine), mine.min(axis=0), mine.max(axis=0))
        yield emit(kept)

    def whole(it):
        kept: dict = {}
        for batch in it:
            for r in batch.to_pylist():
                add(kept, r["cell"], r["n"], np.array(r["lo"], float), np.array(r["hi"], float))
        yield emit(kept)

    # one row for each cell at most, whatever the rows
    found = placed.mapInArrow(part, schema).repartition("cell").mapInArrow(whole, schema).orderBy("cell").collect()
    n = np.array([r["n"] for r in found])
    return Boxes(
        np.array([r["cell"] for r in found], np.int32),
        np.array([r["lo"] for r in found], float).reshape(len(found), width),
        np.array([r["hi"] for r in found], float).reshape(len(found), width),
        -(-n // shard_rows),
    )


def visits(asked: DataFrame, boxes: Boxes, k: int, seed_ids: np.ndarray, seeds: np.ndarray, first: bool) -> DataFrame:
    """Queries (``id``, ``v``, ``best``: scores known) by ``shard``: of the cell whose
    box promises most, or of all others whose box reaches the k-th score known."""
    width, start = boxes.lo.shape[1], boxes.first_shard

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            v = rows_of(batch.column("v"), width)
            reach = boxes.bounds(v)
            home = np.argmax(reach, axis=1)
            if first:
                pairs = list(enumerate(home))
            else:
                low = np.full(len(v), -np.inf)
                q = v.astype(object) if seeds.dtype == object else v
                for i, (known, seen) in enumerate(zip(batch.column("best").to_pylist(), seed_bounds(q, batch.column("id").to_pylist(), seed_ids, seeds, k))):
                    low[i] = max([float(min(x)) for x in (known, [s for s, _ in seen]) if x and len(x) == k], default=-np.inf)
                reach[np.arange(len(v)), home] = -np.inf
                pairs = zip(*np.nonzero((reach >= low[:, None]) & (reach > -np.inf)))
            at, shard = [], []
            for i, c in pairs:
                at += [i] * int(boxes.shards[c])
                shard += range(int(start[c]), int(start[c + 1]))
            took = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(np.ones(len(at), np.int32)), took.column("id"), took.column("v"), took.column("best")],
                ["shard", "asks", "id", "v", "best"],
            )

    return asked.mapInArrow(run, "shard int, asks int, id long, v array<long>, best array<long>")


def top_k(
    table: DataFrame,
    k: int = K,
    every: int = EVERY,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = SCALE,
    shard_rows: int = SHARD_ROWS,
    cells: int = CELLS,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for rows whose id is divisible by ``every``."""
    named, i, v = by_place(table), place(table, id_col), place(table, vector_col)
    whole = F.transform(F.col(v), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fine = F.forall(F.col(v), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = named.where(F.col(i).isNotNull() & F.col(v).isNotNull() & fine).select(F.col(i).cast("long").alias("id"), whole.alias("v"))
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = width or 0
    # at most CELLS * CELL_SAMPLE rows come to the driver
    cells = max(1, min(cells, n // shard_rows))
    sampled = rows.orderBy(F.xxhash64("id"), "id").limit(max(SEEDS, cells * CELL_SAMPLE)).collect()
    seed_ids = np.array([r["id"] for r in sampled[:SEEDS]], dtype=np.int64)
    seeds = matrix([r["v"] for r in sampled[:SEEDS]], width)
    cuts = Cuts.of(matrix([r["v"] for r in sampled], width).astype(float), cells)

    def assign(it):
        for batch in it:
            cell = cuts.cells_of(rows_of(batch.column("v"), width).astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("id"), batch.column("v")], ["cell", "id", "v"])

    # written once, for the boxes and both visits
    corpus = cut(rows.mapInArrow(assign, "cell int, id long, v array<long>"))
    boxes = _boxes(corpus, width, shard_rows)
    shards = int(boxes.first_shard[-1])
    if not shards:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    asked = corpus.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))

    number = {int(c): (int(boxes.first_shard[j]), int(boxes.shards[j])) for j, c in enumerate(boxes.cell)}
    start = F.element_at(F.array(*[F.lit(number.get(c, (0, 1))[0]) for c in range(cells)]), F.col("cell") + 1)
    many = F.element_at(F.array(*[F.lit(number.get(c, (0, 1))[1]) for c in range(cells)]), F.col("cell") + 1)
    nothing = F.lit(None).cast("array<long>")
    dealt = corpus.select(
        (start + F.pmod(F.xxhash64("id", F.lit(7)), many.cast("long"))).cast("int").alias("shard"), F.lit(0).alias("asks"), "id", "v", nothing.alias("best")
    )

    def search(it):
        shard, tree = None, None
        have_ids, have = [], []

        def closed() -> Tree:
            ids = np.concatenate(have_ids) if have_ids else np.zeros(0, np.int64)
            return Tree(ids, _stack(have, width))

        for batch in it:
            shards_, asks, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "asks", "id"))
            edges = np.flatnonzero(np.diff(shards_ * 2 + asks)) + 1
            for a, b in zip([0, *edges], [*edges, len(ids)]):
                if a == b:
                    continue
                if shards_[a] != shard:
                    shard, tree, have_ids, have = shards_[a], None, [], []
                got = rows_of(batch.column("v").slice(a, b - a), width)
                if not asks[a]:
                    have_ids.append(ids[a:b])
                    have.append(got)
                    continue
                tree = tree or closed()
                if tree.v.dtype == object or seeds.dtype == object:
                    got = got.astype(object) if got.dtype == object else np.vectorize(int, otypes=[object])(got)
                own = ids[a:b].tolist()
                bound = seed_bounds(got, own, seed_ids, seeds, k)
                for j, known in enumerate(batch.column("best").slice(a, b - a).to_pylist()):
                    # scores that exist elsewhere; any id may stand beside them, so ties still count
                    if known and len(known) == k and (len(bound[j]) < k or min(known) > bound[j][0][0]):
                        bound[j] = [(s, -TOP - 1) for s in sorted(known)]
                found = tree.search(got, own, bound, k)
                flat = [(q, -m, s) for q, best in zip(own, found) for s, m in best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[c] for f in flat], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"]
                )

    def answers(questions: DataFrame) -> DataFrame:
        return (
            dealt.unionByName(questions)
            .repartition(shards, "shard")
            .sortWithinPartitions("shard", "asks", "id")
            .mapInArrow(search, "query_id long, vec_id long, score long")
        )

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best_of(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    ask = asked.select("id", "v", nothing.alias("best"))
    found = answers(visits(ask, boxes, k, seed_ids, seeds, True))
    if len(boxes.cell) > 1:
        found = cut(found)
        known = best_of(found).groupBy("query_id").agg(F.collect_list("score").alias("best"))
        ask = asked.join(known, F.col("id") == F.col("query_id"), "left").select("id", "v", "best")
        found = found.unionByName(answers(visits(ask, boxes, k, seed_ids, seeds, False)))
    return best_of(found).select("query_id", "rank", "vec_id", "score")


def _stack(parts: list[np.ndarray], width: int) -> np.ndarray:
    if not parts:
        return np.zeros((0, width))
    if any(p.dtype == object for p in parts):
        return np.concatenate([np.vectorize(int, otypes=[object])(p) if p.dtype != object and p.size else p.astype(object) for p in parts])
    return np.concatenate(parts)
