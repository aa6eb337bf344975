"""Per-key totals that stay even when a few keys own most rows.

Rows are never moved to their key. Every input split encodes its keys with
its own dictionary and reduces them into dense arrays (bincount and
scatter-reduce), so a task's work follows the size of its split, whatever the
keys. Only array blocks are shuffled: one block per (group, page of the key
space) and split, and a page is summed as its blocks stream by, sorted by page,
so that a task holds one page at a time.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A split's dictionary is written out and begun anew beyond this many entries.
DICTIONARY_LIMIT = 500_000
PAGES = 512
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = {"sum": 0, "min": np.iinfo(np.int64).max, "max": np.iinfo(np.int64).min}
_SCATTER = {"sum": np.add, "min": np.minimum, "max": np.maximum}


def _fits(sums: np.ndarray) -> None:
    if (np.abs(sums) >= 2.0**63).any():
        raise OverflowError("a sum does not fit 64 bits")


class Accumulators:
    """A growing key dictionary and, aligned with it, one dense array per total."""

    def __init__(self, kinds: list[str]) -> None:
        self.kinds = kinds
        self.code: dict[int, int] = {}
        self.n = np.zeros(64, np.int64)
        self.totals = [np.full(64, _EMPTY[k], np.int64) for k in kinds]

    def _encode(self, keys: np.ndarray) -> np.ndarray:
        code = self.code
        codes = np.fromiter((code.setdefault(k, len(code)) for k in keys.tolist()), np.int64, len(keys))
        while len(code) > len(self.n):
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
            self.totals = [np.concatenate([t, np.full_like(t, _EMPTY[k])]) for k, t in zip(self.kinds, self.totals)]
        return codes

    def add_rows(self, keys: np.ndarray, values: list[np.ndarray]) -> None:
        unique, inverse = np.unique(keys, return_inverse=True)
        at = self._encode(unique)
        self.n[at] += np.bincount(inverse, minlength=len(unique))
        codes = at[inverse]
        for kind, total, value in zip(self.kinds, self.totals, values):
            if kind == "sum":
                _fits(total[at] + np.bincount(inverse, value.astype(np.float64), len(unique)))
            _SCATTER[kind].at(total, codes, value)

    def add_block(self, keys: np.ndarray, n: np.ndarray, totals: list[np.ndarray]) -> None:
        at = self._encode(keys)
        self.n[at] += n
        for kind, own, other in zip(self.kinds, self.totals, totals):
            if kind == "sum":
                _fits(own[at] + other.astype(np.float64))
            own[at] = _SCATTER[kind](own[at], other)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        k = len(self.code)
        return np.fromiter(self.code, np.int64, k), self.n[:k], [t[:k] for t in self.totals]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _blocks(kinds: list[str], pages: int):
    """Map side: one split's rows to (group, page, keys, n, totals) array blocks."""

    def write(held: dict[str, Accumulators]) -> Iterator[pa.RecordBatch]:
        groups, numbers, columns = [], [], [[] for _ in range(2 + len(kinds))]
        for group, acc in held.items():
            keys, n, totals = acc.arrays()
            page = ((keys.astype(np.uint64) * _MIX) >> np.uint64(33)).astype(np.int64) % pages
            order = np.argsort(page, kind="stable")
            cuts = np.flatnonzero(np.diff(page[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                groups.append(group)
                numbers.append(int(page[part[0]]))
                for column, array in zip(columns, [keys, n, *totals]):
                    column.append(array[part])
        names = ["grp", "page", "keys", "n", *(f"t{i}" for i in range(len(kinds)))]
        if groups:
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(numbers, pa.int32()), *map(_lists, columns)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Accumulators] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).dictionary_encode()
            at = group.indices.to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            values = [batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(kinds))]
            for g, name in enumerate(group.dictionary.to_pylist()):
                of = at == g
                held.setdefault(name, Accumulators(kinds)).add_rows(keys[of], [v[of] for v in values])
            if sum(len(a.code) for a in held.values()) > DICTIONARY_LIMIT:
                yield from write(held)
                held = {}
        yield from write(held)

    return run


def _sum_blocks(kinds: list[str]):
    """Reduce side: the blocks of a page come one after another and are added into one dense array each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, acc = None, Accumulators(kinds)

        def summed() -> pa.RecordBatch:
            keys, n, totals = acc.arrays()
            return pa.RecordBatch.from_arrays(
                [pa.array([page[0]] * len(keys), pa.string()), pa.array(keys), pa.array(n), *map(pa.array, totals)],
                ["grp", "key_id", "n", *(f"t{i}" for i in range(len(kinds)))],
            )

        for batch in batches:
            lists = [batch.column(2 + i) for i in range(2 + len(kinds))]
            names = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for row, name in enumerate(names):
                if name != page:
                    if page is not None:
                        yield summed()
                    page, acc = name, Accumulators(kinds)
                acc.add_block(*(x[row].values.to_numpy(zero_copy_only=False) for x in lists[:2]), [x[row].values.to_numpy(zero_copy_only=False) for x in lists[2:]])
        if page is not None:
            yield summed()

    return run


def totals_by_key(df: DataFrame, key: Column, group: Column, totals: dict[str, tuple[str, Column]] | None = None, pages: int = PAGES) -> DataFrame:
    """Row count and integer totals of every key in every group.

    ``key`` is an integer column, ``group`` a string column of few values
    (a month, a source), ``totals`` maps an output name to ``(kind, column)``
    with kind sum, min or max. Returns ``grp, key_id, n`` and the totals.

    Rows whose key or group is null belong to no key and do not count. A null
    value adds nothing; a key with only null values has a null total. A sum that
    does not fit 64 bits fails the query. Repeated rows count as often as they occur. An empty input gives no rows. Other
    columns of ``df`` are not read, so their names can't clash.
    """
    totals = totals or {}
    kinds = [kind for kind, _ in totals.values()]
    if bad := set(kinds) - set(_EMPTY):
        raise ValueError(f"totals are sum, min or max, not {sorted(bad)}")
    # A total that ignores nulls must still tell "no value" from any value, so each brings the count of its values.
    names, columns, extra = [], [], []
    for name, (kind, column) in totals.items():
        value = column.cast("long")
        names.append((name, len(columns)))
        columns.append(F.coalesce(value, F.lit(int(_EMPTY[kind]))))
        extra.append((name, value))
    for name, value in extra:
        columns.append(value.isNotNull().cast("long"))
        kinds.append("sum")
    rows = df.select(group.cast("string").alias("grp"), key.cast("long").alias("k"), *(c.alias(f"t{i}") for i, c in enumerate(columns))).where("grp IS NOT NULL AND k IS NOT NULL")
    arrays = ", ".join(f"t{i} array<long>" for i in range(len(kinds)))
    blocks = rows.mapInArrow(_blocks(kinds, pages), "grp string, page int, keys array<long>, n array<long>" + (f", {arrays}" if kinds else ""))
    flat = ", ".join(f"t{i} long" for i in range(len(kinds)))
    summed = blocks.repartition("grp", "page").sortWithinPartitions("grp", "page").mapInArrow(_sum_blocks(kinds), "grp string, key_id long, n long" + (f", {flat}" if kinds else ""))
    seen = {name: F.col(f"t{len(totals) + i}") > 0 for i, (name, _) in enumerate(extra)}
    out = [F.when(seen[name], F.col(f"t{i}")).alias(name) for name, i in names]
    return summed.select("grp", "key_id", "n", *out)


def dominant_keys(counts: DataFrame, one_in: int = 25, at_least: int = 10) -> DataFrame:
    """Keys of ``totals_by_key`` that hold at least ``1/one_in`` of their group and ``at_least`` rows."""
    whole = counts.groupBy("grp").agg(F.sum("n").alias("whole"))
    return counts.join(whole, "grp").where((F.col("n") * one_in >= F.col("whole")) & (F.col("n") >= at_least)).select("grp", "key_id", "n", "whole")
