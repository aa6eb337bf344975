import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.operators import heavy_keys as H

SCHEMA = "k long, g string, v int, keys string, n long, page int"


def totals(df, **kinds):
    out = H.totals_by_key(df, F.col("k"), F.col("g"), {name: (kind, F.col("v")) for name, kind in kinds.items()})
    return {(r["grp"], r["key_id"]): r for r in out.collect()}


def test_against_brute_force_with_a_hot_key(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.6 else rng.randrange(-50, 3000), rng.choice("ab"), rng.randrange(-9, 9), "x", 1, 2) for _ in range(6000)]
    counts, sums, low = Counter(), Counter(), defaultdict(lambda: 99)
    for k, g, v, *_ in rows:
        counts[g, k] += 1
        sums[g, k] += v
        low[g, k] = min(low[g, k], v)
    got = totals(spark.createDataFrame(rows, SCHEMA).repartition(7), s="sum", lo="min", hi="max")
    assert {k: (r["n"], r["s"], r["lo"]) for k, r in got.items()} == {k: (counts[k], sums[k], low[k]) for k in counts}


def test_nulls_and_repeats(spark):
    rows = [(1, "a", None), (1, "a", None), (None, "a", 5), (2, None, 5), (3, "a", 0), (3, "a", None)]
    got = totals(spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA), s="sum", lo="min")
    assert {k: (r["n"], r["s"], r["lo"]) for k, r in got.items()} == {("a", 1): (2, None, None), ("a", 3): (2, 0, 0)}


def test_empty_table(spark):
    assert totals(spark.createDataFrame([], SCHEMA), s="sum") == {}


def test_extreme_keys_and_small_dictionaries(spark):
    acc = H.Accumulators(["sum"])
    import numpy as np

    big = np.array([2**63 - 1, -(2**63), 0, 2**63 - 1])
    acc.add_rows(big, [np.array([1, 2, 3, 4])])
    keys, n, (s,) = acc.arrays()
    assert dict(zip(keys.tolist(), zip(n.tolist(), s.tolist()))) == {2**63 - 1: (2, 5), -(2**63): (1, 2), 0: (1, 3)}


def test_unknown_total(spark):
    with pytest.raises(ValueError):
        totals(spark.createDataFrame([], SCHEMA), s="median")


def test_dominant_keys(spark):
    rows = [(1, "a", 0, "", 0, 0)] * 30 + [(k, "a", 0, "", 0, 0) for k in range(100, 200)] + [(5, "b", 0, "", 0, 0)] * 9
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.dominant_keys(H.totals_by_key(df, F.col("k"), F.col("g"))).collect()
    assert [(r["grp"], r["key_id"], r["n"], r["whole"]) for r in got] == [("a", 1, 30, 130)]


def test_extreme_values_and_sums_that_do_not_fit(spark):
    df = spark.createDataFrame([(1, "a", 2**63 - 1), (2, "a", -(2**63)), (2, "a", None)], "k long, g string, v long")
    got = totals(df, lo="min", hi="max")
    assert (got["a", 1]["lo"], got["a", 2]["hi"]) == (2**63 - 1, -(2**63))
    with pytest.raises(Exception, match="does not fit 64 bits"):
        totals(spark.createDataFrame([(1, "a", 2**62)] * 2, "k long, g string, v long").repartition(2), s="sum")
