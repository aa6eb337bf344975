"""Items that appear together, counted by stripes.

Every input split keeps, per item, an associative array of the neighbours it
met and how often (the item's stripe), as sorted code arrays. Stripes are
shuffled by item. The stripe of an item whose baskets hold many items is cut
into slices by a hash of the neighbour, as many as its load asks for, so that
it is shared by several tasks. Equal keys are merged while the sorted blocks
stream by; what is carried from batch to batch is merged too, so that a task
holds a key's distinct neighbours and not its blocks. A log-likelihood ratio
then rates each pair against chance.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.storage import materialise

#: A basket's pairs are formed in pieces of about this many, which may go to different tasks.
PIECE_PAIRS = 1_000_000
#: A split's stripes are written out and begun anew beyond this many entries.
STRIPE_LIMIT = 3_000_000
#: An item whose baskets hold more items than this (or than 1 / MOST_HOT of all, which bounds their number) is sliced.
SLICE_LOAD, MOST_HOT = 100_000, 4_000
#: Carried blocks of a key are merged beyond this many entries.
CARRIED = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def baskets(df: DataFrame, basket: Column, group: Column, items: Column) -> DataFrame:
    """``basket, grp, items``: the distinct non-null items of all rows of a basket and group, sorted.

    Rows with a null basket, group or list and baskets left without items
    give nothing; repeated and partial deliveries of a basket are united.
    """
    rows = df.select(basket.alias("basket"), group.alias("grp"), F.explode(items).alias("item")).where("basket IS NOT NULL AND grp IS NOT NULL AND item IS NOT NULL")
    return rows.groupBy("basket", "grp").agg(F.sort_array(F.collect_set(F.col("item").cast("long"))).alias("items"))


def _merge(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum ``n`` of equal (a, b); sorted by a, then b."""
    if not len(a):
        return a, b, n
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(n, first)


def _later(values: np.ndarray, offsets: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists cut by ``offsets``: each item at a position in [lo, hi) with every later item of its list."""
    size = np.diff(offsets)
    position = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], size)
    of = np.repeat(np.arange(len(size)), size)
    follow = np.where((position >= lo[of]) & (position < hi[of]), size[of] - 1 - position, 0)
    at = np.repeat(np.arange(len(position)), follow)
    step = np.arange(len(at)) - np.repeat(np.cumsum(follow) - follow, follow)
    return values[at], values[at + 1 + step]


def _batch_pairs(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    groups = batch.column(0).dictionary_encode()
    of_group = groups.indices.to_numpy(zero_copy_only=False)
    lo, hi = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
    for g, name in enumerate(groups.dictionary.to_pylist()):
        rows = np.flatnonzero(of_group == g)
        lists = batch.column(1).take(pa.array(rows))
        values = lists.flatten().to_numpy(zero_copy_only=False)
        offsets = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        held = np.cumsum(np.minimum(hi[rows] - lo[rows], 1 << 20) * np.diff(offsets))
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(held // (4 * PIECE_PAIRS))) + 1):
            if len(part):
                s, e = part[0], part[-1] + 1
                a, b = _later(values[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s], lo[rows[s:e]], hi[rows[s:e]])
                yield name, *_merge(a, b, np.ones(len(a), np.int64))


Hot = dict[str, tuple[np.ndarray, np.ndarray]]


def _slices(hot: Hot, group: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The slice of each (item, neighbour): 0 for items that are not hot."""
    items, slices = hot.get(group, (np.zeros(0, np.int64),) * 2)
    if not len(items):
        return np.zeros(len(a), np.int32)
    at = np.minimum(np.searchsorted(items, a), len(items) - 1)
    of = np.where(items[at] == a, slices[at], 1).astype(np.uint64)
    return (((b.astype(np.uint64) * _MIX) >> np.uint64(33)) % of).astype(np.int32)


def _stripes(hot: Hot):
    def write(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for name, parts in held.items():
            a, b, n = _merge(*map(np.concatenate, zip(*parts)))
            part = _slices(hot, name, a, b)
            order = np.lexsort((b, part, a))
            a, b, n, part = a[order], b[order], n[order], part[order]
            first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])]) if len(a) else np.zeros(0, np.int64)
            offsets = pa.array(np.r_[first, len(a)].astype(np.int32))
            if len(first):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(first)), pa.array(a[first]), pa.array(part[first]), pa.ListArray.from_arrays(offsets, pa.array(b)), pa.ListArray.from_arrays(offsets, pa.array(n))],
                    ["grp", "item", "slice", "neighbours", "counts"],
                )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for name, a, b, n in _batch_pairs(batch):
                held.setdefault(name, []).append((a, b, n))
                size += len(a)
            if size > STRIPE_LIMIT:
                held = {name: [_merge(*map(np.concatenate, zip(*parts)))] for name, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > STRIPE_LIMIT // 2:
                    yield from write(held)
                    held, size = {}, 0
        yield from write(held)

    return run


def _merge_stripes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks arrive sorted by (grp, item, slice); equal keys are merged as they pass, and the last is carried to the next batch."""

    def pairs(names: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        key, b, n = _merge(key, b, n)
        return pa.RecordBatch.from_arrays([pa.array(names[key], pa.string()), pa.array(a[key]), pa.array(b), pa.array(n)], ["grp", "item_a", "item_b", "n_ab"])

    last, carried, size, merged = None, [], 0, 0

    def closed() -> pa.RecordBatch:
        b, n = map(np.concatenate, zip(*carried))
        return pairs(np.array([last[0]], object), np.zeros(len(b), np.int64), np.array([last[1]]), b, n)

    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.asarray(batch.column(0).to_pylist(), object)
        item, part = (batch.column(i).to_numpy() for i in (1, 2))
        first = np.r_[True, (names[1:] != names[:-1]) | (item[1:] != item[:-1]) | (part[1:] != part[:-1])]
        starts, length = np.flatnonzero(first), pc.list_value_length(batch.column(3)).to_numpy()
        key = np.repeat(np.cumsum(first) - 1, length)
        b, n = (pc.list_flatten(batch.column(i)).to_numpy() for i in (3, 4))
        if last is not None and last != (names[0], item[0], part[0]):
            yield closed()
            carried, size, merged = [], 0, 0
        if len(starts) > 1 and carried:
            carried.append((b[key == 0], n[key == 0]))
            yield closed()
            carried, size, merged, key = [], 0, 0, np.where(key == 0, -1, key)
        done = (key >= 0) & (key < len(starts) - 1)
        if done.any():
            yield pairs(names[starts], key[done], item[starts], b[done], n[done])
        rest = key == len(starts) - 1
        last, size = (names[-1], item[-1], part[-1]), size + int(rest.sum())
        carried.append((b[rest], n[rest]))
        if size > max(CARRIED, 2 * merged):
            carried = [_merge(np.zeros(size, np.int64), *map(np.concatenate, zip(*carried)))[1:]]
            size = merged = len(carried[0][0])
    if carried:
        yield closed()


def _hot(loads: DataFrame) -> Hot:
    """Slices of the items with the greatest loads: at most ``MOST_HOT`` rows come to the driver."""
    whole = loads.agg(F.sum("load").alias("load")).head()["load"] or 0
    width = max(SLICE_LOAD, -(-whole // MOST_HOT))
    out: dict[str, list] = {}
    for r in loads.where(F.col("load") > width).select("grp", "item", "load").collect():
        out.setdefault(r["grp"], []).append((r["item"], -(-r["load"] // width)))
    return {g: tuple(np.array(c, np.int64) for c in zip(*sorted(rows))) for g, rows in out.items()}


def item_loads(of: DataFrame) -> DataFrame:
    """``grp, item, n_item, load``: the baskets that hold an item, and all items in these."""
    return of.select("grp", F.size("items").cast("long").alias("size"), F.explode("items").alias("item")).groupBy("grp", "item").agg(F.count(F.lit(1)).alias("n_item"), F.sum("size").alias("load"))


def pair_counts(of: DataFrame, loads: DataFrame | None = None) -> DataFrame:
    """``grp, item_a, item_b, n_ab`` with item_a < item_b: the baskets of ``baskets()`` that hold both. ``loads`` as from ``item_loads(of)``."""
    rows = f"greatest(1, CAST({PIECE_PAIRS} DIV size(items) AS INT))"
    pieces = of.where(F.size("items") > 1).select("grp", "items", F.explode(F.expr(f"sequence(0, size(items) - 2, {rows})")).alias("lo")).select("grp", "items", "lo", F.expr(f"lo + {rows}").alias("hi"))
    stripes = pieces.mapInArrow(_stripes(_hot(item_loads(of) if loads is None else loads)), "grp string, item long, slice int, neighbours array<long>, counts array<long>")
    sorted_stripes = stripes.repartition("grp", "item", "slice").sortWithinPartitions("grp", "item", "slice")
    return sorted_stripes.mapInArrow(_merge_stripes, "grp string, item_a long, item_b long, n_ab long")


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.ln(x)).otherwise(0.0)


def associations(of: DataFrame, min_together: int = 1) -> DataFrame:
    """``grp, item_a, item_b, n_ab, n_a, n_b, n, lift, llr`` of every pair in at least ``min_together`` baskets.

    ``n`` counts the group's baskets, ``lift`` is n_ab n / (n_a n_b), ``llr``
    the log-likelihood ratio of the 2x2 table, signed: negative where the pair
    is rarer than chance lets expect.
    """
    of = materialise(of, "baskets")
    single = materialise(item_loads(of), "items")
    whole = of.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    pairs = pair_counts(of, single).where(F.col("n_ab") >= min_together)
    rated = (
        pairs.join(single.select("grp", F.col("item").alias("item_a"), F.col("n_item").alias("n_a")), ["grp", "item_a"])
        .join(single.select("grp", F.col("item").alias("item_b"), F.col("n_item").alias("n_b")), ["grp", "item_b"])
        .join(whole, "grp")
    )
    ab, a, b, n = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    cells = [ab, a - ab, b - ab, n - a - b + ab]
    matrix = _plogp(cells[0]) + _plogp(cells[1]) + _plogp(cells[2]) + _plogp(cells[3])
    margins = _plogp(a) + _plogp(n - a) + _plogp(b) + _plogp(n - b)
    llr = F.greatest(F.lit(0.0), 2 * (matrix - margins + _plogp(n)))
    return rated.select("grp", "item_a", "item_b", "n_ab", "n_a", "n_b", "n", (ab * n / (a * b)).alias("lift"), F.when(ab * n >= a * b, llr).otherwise(-llr).alias("llr"))
