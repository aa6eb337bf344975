"""The k most similar vectors of every vector.

Unit vectors are projected onto a few Gaussian (2-stable) directions. The
projected space is cut into cells by a kd-tree whose upper planes are fitted on
a bounded sample; every vector is indexed in its cell, and each cell has its own
kd-tree down to leaves. Along a direction, the squared projected distance over
the squared true distance follows a chi-square law of one degree of freedom, and
over all m directions one of m degrees. Two tests use this to stop:

* Between cells: the chance that a neighbour at the distance of the current k-th
  lies in a cell is the product over the directions of what the one-degree law
  gives for the cell's interval. A query visits cells in the order of this
  chance until the chance of all others together is below 1 - ``CONFIDENCE``.
* Between the leaves of a cell, in the order of their projected distance, exact
  cosines are verified until the m-degree law says that a nearer vector would,
  with probability ``CONFIDENCE``, have been met by then.

First every cell searches itself, which bounds each query's k-th distance; a
least similarity that the caller asks for bounds it from the start. Then each
query goes to the other cells it must visit, and each cell's index moves once
for as many queries as one task takes. A pair at the asked similarity that
either side finds counts for both. Equal vectors are searched once and share the
result.
"""

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.plans.storage import materialise

DIRECTIONS = 8
CONFIDENCE = 0.99
LEAF = 256
BLOCK = 256  # queries that are verified together
STEP = 8  # leaves that are verified at once
SAMPLE = 20_000  # vectors, about, on which the cells' planes are fitted
CELL_ROWS = (4_096, 65_536)  # least and most vectors of a cell, about
CELLS = 1_024  # cells that are aimed at between these sizes
VISITS = 4  # times a cell's rows: the queries that one task takes
DIGITS = 12

_Z = np.linspace(-9, 9, 8193)
_BELOW = np.array([math.erfc(-z / math.sqrt(2)) / 2 for z in _Z])  # the one-degree law, by sign
_ASSIGNED = "rep long, cell int, share int, v array<float>, asks boolean"
_ROUTED = "rep long, target int, share int, v array<float>, bound double"
_FOUND = "rep long, near long, cosine double"
_FIRST = "rep long, cell int, v array<float>, bound double, ids array<long>, cosines array<double>"


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of the chi-square law with an even number m of degrees of freedom."""
    low, high = 0.0, 20.0 * m
    for _ in range(100):
        x = (low + high) / 2
        cdf = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        low, high = (x, high) if cdf < p else (low, x)
    return high


def directions(width: int, m: int = DIRECTIONS) -> np.ndarray:
    return np.random.default_rng(20_240_229).standard_normal((width, m))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def kd_leaves(y: np.ndarray, size: int) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree over ``y``, each cut across its widest direction; all but one are full."""
    leaves, todo = [], [np.arange(len(y))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            leaves.append(rows)
            continue
        part = y[rows]
        cut = size * (-(-len(rows) // size) // 2)
        half = np.argpartition(part[:, np.argmax(np.ptp(part, axis=0))], cut)
        todo += [rows[half[cut:]], rows[half[:cut]]]
    return leaves


def _merged(nearest: tuple[np.ndarray, np.ndarray], row: np.ndarray, ids: np.ndarray, cosines: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows' nearest so far and new candidates, the best ``keep``: higher cosine, then smaller id."""
    old_ids, old = nearest
    n = len(old)
    row = np.r_[np.repeat(np.arange(n), keep), row]
    ids, cosines = np.r_[old_ids.ravel(), ids], np.r_[old.ravel(), cosines]
    order = np.lexsort((ids, -cosines, row))
    row = row[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    best = order[rank < keep]
    return ids[best].reshape(n, keep), cosines[best].reshape(n, keep)


def _in_steps(leaves: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Leaves in their order, a few at a time; one that is not full stands alone."""
    short = np.flatnonzero(size[leaves] != LEAF)
    parts = np.split(leaves, np.unique(np.r_[short, short + 1]))
    return [step for part in parts if len(part) for step in np.array_split(part, -(-len(part) // STEP))]


def _at_least(near: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of entries that reach their row's floor. Most leaves hold none, so their maxima are looked at first."""
    if near.shape[1] % LEAF:
        return np.nonzero(near >= floor[:, None])
    leaves = near.reshape(len(near), -1, LEAF)
    i, leaf = np.nonzero(leaves.max(axis=2) >= floor[:, None])
    k, j = np.nonzero(leaves[i, leaf] >= floor[i, None])
    return i[k], leaf[k] * LEAF + j


def search(q: np.ndarray, bound: np.ndarray, x: np.ndarray, x_ids: np.ndarray, keep: int, m: int = DIRECTIONS, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """The ``keep`` nearest of unit vectors ``x`` for each unit vector ``q``, of those at a cosine of ``bound`` or more.

    Absent neighbours have the id -1 and the cosine -inf.
    """
    out_ids, out = np.full((len(q), keep), -1, np.int64), np.full((len(q), keep), -np.inf)
    if not len(q) or not len(x):
        return out_ids, out
    r = directions(q.shape[1], m)
    qy, xy = q @ r, x @ r
    leaves = kd_leaves(xy, LEAF)
    order = np.concatenate(leaves)
    x, xy, x_ids = x[order], xy[order], x_ids[order]
    ends = np.cumsum([len(leaf) for leaf in leaves])
    begins = ends - [len(leaf) for leaf in leaves]
    low, high = (np.array([f(xy[b:e], axis=0) for b, e in zip(begins, ends)]) for f in (np.min, np.max))
    x32 = x.astype(np.float32)
    reach = chi_square_quantile(confidence, m)
    for rows in kd_leaves(qy, BLOCK):
        y, own = qy[rows], q[rows]
        own32 = own.astype(np.float32)
        away = np.zeros((len(rows), len(leaves)))
        for d in range(m):
            away += np.maximum(0, np.maximum(low[:, d] - y[:, d, None], y[:, d, None] - high[:, d])) ** 2
        nearest = (out_ids[rows], out[rows])
        kth = bound[rows].copy()
        by_distance = np.argsort(away.min(axis=0), kind="stable")
        for some in _in_steps(by_distance, ends - begins):
            open_ = (away[:, some] <= reach * np.maximum(2 - 2 * kth, 1e-12)[:, None]).any(axis=1)  # the others' tests hold
            if not open_.any():
                continue
            at = np.concatenate([np.arange(begins[i], ends[i]) for i in some])
            active = np.flatnonzero(open_)
            near = own32[active] @ x32[at].T
            if len(at) > keep and np.isneginf(kth[active]).any():
                first = np.partition(near, len(at) - keep, axis=1)[:, len(at) - keep]
                floor = np.maximum(kth[active], first)
            else:
                floor = kth[active]
            i, j = _at_least(near, (floor - 3e-6).astype(np.float32))
            if not len(i):
                continue
            cosines = np.round(np.einsum("ij,ij->i", own[active[i]], x[at[j]]), DIGITS)
            nearest = _merged(nearest, active[i], x_ids[at[j]], cosines, keep)
            kth = np.maximum(kth, nearest[1][:, -1])
        out_ids[rows], out[rows] = nearest
    return out_ids, out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column).to_numpy()
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def _lists(ids: np.ndarray, cosines: np.ndarray) -> tuple[pa.Array, pa.Array]:
    held = ids >= 0
    offsets = pa.array(np.r_[0, np.cumsum(held.sum(axis=1))].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(ids[held])), pa.ListArray.from_arrays(offsets, pa.array(cosines[held]))


def _plant(y: np.ndarray, cells: int) -> list[tuple[int, float, int, int]]:
    """Planes (direction, value, below, beyond) of a kd-tree with ``cells`` cells; children >= 0 are planes, ~child is a cell."""
    planes: list[list] = []
    names = iter(range(cells))

    def grow(rows: np.ndarray, n: int) -> int:
        if n == 1:
            return ~next(names)
        left = n // 2
        d = int(np.argmax(np.ptp(y[rows], axis=0))) if len(rows) > 1 else 0
        value = float(np.quantile(y[rows, d], left / n)) if len(rows) else 0.0
        at = len(planes)
        planes.append([d, value, 0, 0])
        planes[at][2] = grow(rows[y[rows, d] < value], left)
        planes[at][3] = grow(rows[y[rows, d] >= value], n - left)
        return at

    grow(np.arange(len(y)), cells)
    return [tuple(p) for p in planes]


def _cell_of(y: np.ndarray, planes: list) -> np.ndarray:
    at = np.full(len(y), 0 if planes else ~0)
    d, value, below, beyond = (np.array(c) for c in zip(*planes)) if planes else (np.zeros(1, int),) * 4
    while (inner := np.flatnonzero(at >= 0)).size:
        p = at[inner]
        at[inner] = np.where(y[inner, d[p].astype(int)] < value[p], below[p], beyond[p])
    return ~at


def _boxes(planes: list, cells: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full((cells, m), -np.inf), np.full((cells, m), np.inf)

    def walk(at: int, lo: np.ndarray, hi: np.ndarray) -> None:
        if at < 0:
            low[~at], high[~at] = lo, hi
            return
        d, value, below, beyond = planes[at]
        left, right = hi.copy(), lo.copy()
        left[d], right[d] = value, value
        walk(below, lo, left)
        walk(beyond, right, hi)

    walk(0 if planes else ~0, np.full(m, -np.inf), np.full(m, np.inf))
    return low, high


def usable(df: DataFrame, vec_id: str, v: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part: an id and a vector without null, NaN or infinite parts that is not all zero.

    Parts are read as float; -0.0 counts as 0.0. All vectors have one width.
    """
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.expr(f"transform(`{v}`, x -> CAST(x AS FLOAT) + CAST(0 AS FLOAT))").alias("v"))
    return rows.where("vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < CAST('Infinity' AS FLOAT)) AND exists(v, x -> x <> 0)")


def _smallest(keep: int):
    """Of every batch's (rep, vec_id), the ``keep`` smallest ids of each rep: what a hot group sends is bounded."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, ids = (batch.column(i).to_numpy() for i in range(2))
            order = np.lexsort((ids, rep))
            rep, ids = rep[order], ids[order]
            first = np.r_[True, rep[1:] != rep[:-1]] if len(rep) else np.zeros(0, bool)
            rank = np.arange(len(rep)) - np.maximum.accumulate(np.where(first, np.arange(len(rep)), 0))
            yield pa.RecordBatch.from_arrays([pa.array(rep[rank < keep]), pa.array(ids[rank < keep])], ["rep", "vec_id"])

    return run


def _salt(rep: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A part below ``parts`` for each id."""
    mixed = (rep.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    return (mixed % parts.astype(np.uint64)).astype(np.int64)


class _Cells:
    """The cells of a kd-tree; one that holds too many rows is kept as several parts with one box."""

    def __init__(self, planes: list, cells: int, m: int) -> None:
        self.planes, self.m = planes, m
        self.low, self.high = _boxes(planes, cells, m)
        self.parts = np.ones(cells, np.int64)

    def divide(self, rows: dict[int, int], most: int) -> None:
        self.parts = np.array([max(1, -(-rows.get(c, 0) // most)) for c in range(len(self.parts))])

    def of(self, rep: np.ndarray, v: np.ndarray) -> np.ndarray:
        base = _cell_of(_unit(v) @ directions(v.shape[1], self.m), self.planes)
        return (np.cumsum(self.parts) - self.parts)[base] + _salt(rep, self.parts[base])

    def visits(self, y: np.ndarray, cell: np.ndarray, bound: np.ndarray, confidence: float) -> np.ndarray:
        """Which cells, other than their own, queries at projections ``y`` must visit."""
        square = np.maximum(2 - 2 * np.maximum(bound, -1), 1e-12)
        chance, away = np.ones((len(y), len(self.parts))), np.zeros((len(y), len(self.parts)))
        for d in range(self.m):
            edges, at = np.unique(np.r_[self.low[:, d], self.high[:, d]], return_inverse=True)
            low, high = at[: len(self.parts)], at[len(self.parts) :]
            offset = edges - y[:, d, None]
            below = np.interp(offset / np.sqrt(square)[:, None], _Z, _BELOW)
            chance *= below[:, high] - below[:, low]
            away += np.maximum(0, np.maximum(offset[:, low], -offset[:, high])) ** 2
        of = np.repeat(np.arange(len(self.parts)), self.parts)
        each, chance = (chance / self.parts)[:, of], chance[:, of]
        order = np.argsort(-chance, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(each, order, 1), axis=1) - np.take_along_axis(each, order, 1)
        visit = np.zeros(chance.shape, bool)
        np.put_along_axis(visit, order, before < confidence, 1)
        visit &= away[:, of] <= chi_square_quantile(confidence, self.m) * square[:, None]
        visit[np.arange(len(y)), cell] = False
        return visit


def _assign(cells: _Cells, shares: np.ndarray | None = None):
    """(rep, v, asks) to their cells, as often as the cell has shares."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = cells.of(batch.column(0).to_numpy(), _matrix(batch.column(1)))
                times = np.ones(len(cell), np.int64) if shares is None else shares[cell]
                row = np.repeat(np.arange(len(cell)), times)
                share = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                taken = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(cell[row].astype(np.int32)), pa.array(share.astype(np.int32)), taken.column(1), taken.column(2)], ["rep", "cell", "share", "v", "asks"])

    return run


def _search_own(keep: int, m: int, confidence: float, floor: float):
    def run(table: pa.Table) -> pa.Table:
        x, ids, asks = _unit(_matrix(table["v"])), table["rep"].to_numpy(), table["asks"].to_numpy()
        own = table.filter(table["asks"])
        found, cosines = search(x[asks], np.full(int(asks.sum()), floor), x, ids, keep, m, confidence)
        return pa.table([own["rep"], own["cell"], own["v"], pa.array(np.maximum(cosines[:, -1], floor)), *_lists(found, cosines)], ["rep", "cell", "v", "bound", "ids", "cosines"])

    return run


def _route(cells: _Cells, confidence: float, shares: np.ndarray):
    """Queries (rep, cell, v, bound) to the cells they must visit, and there to one of its shares."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 1_000_000 // len(shares))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            v = _matrix(batch.column(2))
            visit = cells.visits(_unit(v) @ directions(v.shape[1], cells.m), batch.column(1).to_numpy(), batch.column(3).to_numpy(), confidence)
            row, target = np.nonzero(visit)
            taken = batch.take(pa.array(row))
            share = _salt(taken.column(0).to_numpy(), shares[target])
            yield pa.RecordBatch.from_arrays([taken.column(0), pa.array(target.astype(np.int32)), pa.array(share.astype(np.int32)), taken.column(2), taken.column(3)], ["rep", "target", "share", "v", "bound"])

    return run


def _search_other(keep: int, m: int, confidence: float, mutual: bool):
    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        if not queries.num_rows or not index.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["rep", "near", "cosine"])
        reps = queries["rep"].to_numpy()
        ids, cosines = search(_unit(_matrix(queries["v"])), queries["bound"].to_numpy(), _unit(_matrix(index["v"])), index["rep"].to_numpy(), keep, m, confidence)
        i, j = np.nonzero(ids >= 0)
        rep, near, cosine = reps[i], ids[i, j], cosines[i, j]
        if mutual:
            rep, near, cosine = np.r_[rep, near], np.r_[near, rep], np.r_[cosine, cosine]
        return pa.table([pa.array(rep), pa.array(near), pa.array(cosine)], ["rep", "near", "cosine"])

    return run


def _nearest(found: DataFrame, keep: int) -> DataFrame:
    """``rep, found`` of (rep, near, cosine): the ``keep`` nearest, by one shuffle and ranks that stop at ``keep``."""
    once = found.repartition("rep").groupBy("rep", "near").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(W.partitionBy("rep").orderBy(F.desc("cosine"), "near"))
    return once.withColumn("_rank", rank).where(F.col("_rank") <= keep).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("far"), F.col("near").alias("near")))).alias("found"))


def nearest_neighbours(
    df: DataFrame, vec_id: str, v: str, k: int = 10, m: int = DIRECTIONS, confidence: float = CONFIDENCE, at_least: float | None = None, queries: Column | None = None
) -> DataFrame:
    """``vec_id, neighbours``: for every usable vector its k most similar others, best first.

    ``neighbours`` holds structs ``(cosine, id)``. Cosines are exact, computed
    in double precision and rounded to 12 decimals; of equal ones the smaller
    id comes first. Unusable vectors (see ``usable``) take no part; equal
    vectors are neighbours of each other; fewer than k others give shorter
    lists; an empty table gives no rows. ``vec_id`` is unique. Other columns
    are not read.

    With ``at_least``, neighbours below that cosine are left out, which spares
    a search most cells. ``queries``, a condition on ``vec_id``, says whose
    neighbours are searched; all rows are searched through.
    """
    if m % 2:
        raise ValueError("the number of directions is even")
    spark, keep, floor = df.sparkSession, k + 1, -np.inf if at_least is None else at_least
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = usable(df, vec_id, v)
    reps = materialise(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max(asks).alias("asks")), "vectors")
    total = reps.count()
    cell_rows = min(max(total // CELLS, CELL_ROWS[0]), CELL_ROWS[1])
    n_cells = max(1, -(-total // cell_rows))
    planes: list = []
    if n_cells > 1:
        # By the hash of a unique id: about SAMPLE rows, wherever they lie.
        sample = reps.where(F.pmod(F.xxhash64("rep"), F.lit(total)) < SAMPLE).select("v").toArrow()
        matrix = _unit(_matrix(sample["v"].combine_chunks()))
        planes = _plant(matrix @ directions(matrix.shape[1], m), n_cells)
    cells = _Cells(planes, n_cells, m)
    vectors = reps.select("rep", "v", "asks")
    if n_cells > 1:  # a row per cell
        cells.divide({r["cell"]: r["count"] for r in vectors.mapInArrow(_assign(cells), _ASSIGNED).groupBy("cell").count().collect()}, 2 * cell_rows)
    first = materialise(vectors.mapInArrow(_assign(cells), _ASSIGNED).groupBy("cell").applyInArrow(_search_own(keep, m, confidence, floor), _FIRST), "cells")
    found = first.select("rep", F.inline(F.arrays_zip(F.col("ids").alias("near"), F.col("cosines").alias("cosine"))))
    if (count := int(cells.parts.sum())) > 1:
        asked = first.select("rep", "cell", "v", "bound")
        one = np.ones(count, np.int64)
        loads = {r["target"]: r["count"] for r in asked.mapInArrow(_route(cells, confidence, one), _ROUTED).groupBy("target").count().collect()}  # a row per cell
        shares = np.array([-(-loads.get(c, 0) // (VISITS * cell_rows)) for c in range(count)])
        routed = asked.mapInArrow(_route(cells, confidence, np.maximum(shares, 1)), _ROUTED)
        index = vectors.mapInArrow(_assign(cells, shares), _ASSIGNED).select("rep", "cell", "share", "v")
        mutual = at_least is not None and queries is None
        found = found.unionByName(routed.groupBy("target", "share").cogroup(index.groupBy("cell", "share")).applyInArrow(_search_other(keep, m, confidence, mutual), _FOUND))
    best = _nearest(found, keep)
    # Members of groups of equal vectors: every id, and of each group the few smallest, which are all that can be someone's neighbour.
    repeated = rows.join(reps.where("n > 1").select("v", "rep"), "v").select("rep", "vec_id")
    members = reps.where("n = 1 AND asks").select("rep", F.col("rep").alias("vec_id")).unionByName(repeated.where(asks))
    smallest = repeated.mapInArrow(_smallest(keep), "rep long, vec_id long").groupBy("rep").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("ids"))
    expanded = (
        best.select("rep", F.inline("found"))
        .join(smallest.withColumnRenamed("rep", "near"), "near", "left")
        .select("rep", "far", F.explode(F.coalesce("ids", F.array("near"))).alias("id"))
        .groupBy("rep")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "id"))), 1, keep).alias("found"))
    )
    return members.join(expanded, "rep").select(
        "vec_id", F.expr(f"transform(slice(filter(found, x -> x.id <> vec_id), 1, {k}), x -> struct(-x.far AS cosine, x.id AS id))").alias("neighbours")
    )


def _verify(k: int):
    """Every query of a block against a part of the rows: its ``k`` nearest there."""

    def run(queries: pa.Table, index: pa.Table) -> pa.Table:
        out: list = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if queries.num_rows and index.num_rows:
            q, x, q_ids, ids = _unit(_matrix(queries["v"])), _unit(_matrix(index["v"])), queries["vec_id"].to_numpy(), index["vec_id"].to_numpy()
            for at in range(0, len(q), BLOCK):
                own = q_ids[at : at + BLOCK]
                near = np.round(q[at : at + BLOCK] @ x.T, DIGITS)
                near[own[:, None] == ids] = -np.inf
                floor = np.partition(near, len(ids) - min(k, len(ids)), axis=1)[:, len(ids) - min(k, len(ids))]
                i, j = np.nonzero((near >= floor[:, None]) & np.isfinite(near))
                order = np.lexsort((ids[j], -near[i, j], i))
                i, j = i[order], j[order]
                first = np.arange(len(i)) - np.searchsorted(i, i) < k
                out = [np.r_[a, b] for a, b in zip(out, (own[i[first]], ids[j[first]], near[i[first], j[first]]))]
        return pa.table([pa.array(c) for c in out], ["rep", "near", "cosine"])

    return run


def exact_neighbours(df: DataFrame, vec_id: str, v: str, k: int, queries: Column, part_rows: int = 65_536) -> DataFrame:
    """``vec_id, neighbours`` as from ``nearest_neighbours``, by brute force for the stated ``queries``: a measure of recall.

    The queries go in blocks to every part of the rows, so the work is their
    number times that of the rows.
    """
    rows = usable(df, vec_id, v)
    parts, blocks = (max(1, -(-x // part_rows)) for x in (rows.count(), rows.where(queries).count()))
    of = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = rows.where(queries).withColumn("part", every(parts)).withColumn("block", of(blocks))
    index = rows.withColumn("part", of(parts)).withColumn("block", every(blocks))
    best = _nearest(asked.groupBy("part", "block").cogroup(index.groupBy("part", "block")).applyInArrow(_verify(k), _FOUND), k)
    return best.select(F.col("rep").alias("vec_id"), F.expr("transform(found, x -> struct(-x.far AS cosine, x.near AS id))").alias("neighbours"))
