import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import cooccurrence as C

SCHEMA = "p long, g string, t array<long>, items string, n_ab int, item_a int"


def rated(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    out = C.associations(C.baskets(df, F.col("p"), F.col("g"), F.col("t")), **options)
    return {(r["grp"], r["item_a"], r["item_b"]): r for r in out.collect()}


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice(["m", "n"]), [rng.choice([1, 1, 2, rng.randrange(60), 10**12 + rng.randrange(5)]) for _ in range(rng.choice([0, 1, 2, 5, 40]))]) for i in range(150)]
    rows += [rows[0], (rows[0][0], rows[0][1], [1, None, 99]), (None, "m", [1, 2]), (700, None, [1, 2]), (701, "m", None), (702, "m", [None]), (703, "m", [])]
    baskets = {}
    for p, g, t in rows:
        if p is not None and g is not None and t:
            baskets.setdefault((p, g), set()).update(x for x in t if x is not None)
    baskets = {k: v for k, v in baskets.items() if v}
    single, pair, whole = Counter(), Counter(), Counter()
    for (_, g), items in baskets.items():
        whole[g] += 1
        single.update((g, x) for x in items)
        pair.update((g, *ab) for ab in combinations(sorted(items), 2))
    got = rated(spark, rows)
    assert {k: (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for k, r in got.items()} == {(g, a, b): (n, single[g, a], single[g, b], whole[g]) for (g, a, b), n in pair.items()}
    r = max(got.values(), key=lambda r: r["n_ab"])
    cells = np.array([[r["n_ab"], r["n_a"] - r["n_ab"]], [r["n_b"] - r["n_ab"], r["n"] - r["n_a"] - r["n_b"] + r["n_ab"]]], float)
    expected = np.outer(cells.sum(1), cells.sum(0)) / cells.sum()
    g2 = 2 * sum(x * math.log(x / e) for x, e in zip(cells.ravel(), expected.ravel()) if x)
    assert abs(abs(r["llr"]) - g2) < 1e-6


def test_hot_items_are_sliced(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(i, "m", [1, 2, *rng.sample(range(3, 400), 6)]) for i in range(800)]
    whole = rated(spark, rows)
    monkeypatch.setattr(C, "SLICE_LOAD", 500)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    hot = C._hot(C.item_loads(C.baskets(df, F.col("p"), F.col("g"), F.col("t"))))
    assert hot["m"][0].tolist() == [1, 2] and (hot["m"][1] > 4).all()
    b = np.arange(3, 400)
    parts = C._slices(hot, "m", np.ones(len(b), np.int64), b)
    assert len(set(parts.tolist())) == hot["m"][1][0] and not C._slices(hot, "m", np.full(len(b), 3), b).any() and not C._slices(hot, "n", b, b).any()
    assert rated(spark, rows) == whole


def test_carried_stripes_stay_small():
    import tracemalloc

    import pyarrow as pa

    def batches(n):
        for i in range(n):
            b = np.arange(i % 7, 20_000, 7)
            yield pa.RecordBatch.from_arrays([pa.array(["m"]), pa.array([1]), pa.array([0], pa.int32()), pa.array([b.tolist()], pa.list_(pa.int64())), pa.array([[1] * len(b)], pa.list_(pa.int64()))], list("abcde"))

    peak = []
    for n in (100, 400):
        tracemalloc.start()
        got = pa.Table.from_batches(C._merge_stripes(batches(n)))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert got.num_rows == 20_000 and sum(got["n_ab"].to_pylist()) == sum(len(range(i % 7, 20_000, 7)) for i in range(n))
    assert peak[1] < 1.5 * peak[0]


def test_small_limits_give_the_same(spark):
    values = np.arange(300)
    a, b = C._later(values, np.array([0, 100, 300]), np.array([0, 0]), np.array([100, 200]))
    assert len(a) == 100 * 99 // 2 + 200 * 199 // 2 and (a < b).all()


def test_empty(spark):
    assert rated(spark, []) == {}


def test_merge_over_batches():
    import pyarrow as pa

    rows = [("m", 1, 0, [2, 3], [1, 1]), ("m", 1, 0, [3], [4]), ("m", 1, 0, [5], [1]), ("n", 1, 0, [3], [2]), ("n", 2, 0, [9], [7])]
    types = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[i]], t) for i, t in enumerate(types)], list("abcde")) for r in rows]
    got = pa.Table.from_batches(C._merge_stripes(batches)).to_pylist()
    assert sorted(map(tuple, (r.values() for r in got))) == [("m", 1, 2, 1), ("m", 1, 3, 5), ("m", 1, 5, 1), ("n", 1, 3, 2), ("n", 2, 9, 7)]
