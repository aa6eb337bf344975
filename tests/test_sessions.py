import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators.activity_sessions import closed, earliest, sessions


def brute(rows, gap):
    out, by = [], {}
    for e, t in rows:
        if e is not None and t is not None:
            by.setdefault(e, []).append(t)
    for e, ts in by.items():
        ts.sort()
        begin = last = ts[0]
        n = 1
        for t in ts[1:]:
            if t - last <= gap:
                n += 1
            else:
                out.append((e, begin, last, last - begin, n))
                begin, n = t, 1
            last = t
        out.append((e, begin, last, last - begin, n))
    return sorted(out)


def got(spark, rows, gap):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "client long, us long, entity string, word int")
    return sorted(tuple(r) for r in sessions(df, "client", "us", gap).collect())


@pytest.mark.parametrize("gap", [1, 2, 7, 16, 17, 18, 100, 1000, 1_800_000_000])
def test_against_brute_force(spark, gap):
    rng = random.Random(gap)
    rows = [(rng.choice([1, 1, 1, 2, 3]), 1_000_000 + int(gap * rng.expovariate(1) * rng.choice([1, 5, 60])) + rng.randrange(3)) for _ in range(700)]
    rows += [(9, 50), (9, 50 + gap), (9, 50 + 2 * gap + 1), (None, 5), (4, None), (5, 1), (5, 1), (6, -5), (6, -5 + gap)]
    assert got(spark, rows, gap) == brute(rows, gap)


def test_empty_and_bad_gap(spark):
    assert got(spark, [], 10) == []
    with pytest.raises(ValueError):
        got(spark, [], 0)


@pytest.mark.parametrize("reach", range(1, 17))
def test_closing_fills_holes_up_to_the_reach(spark, reach):
    row = spark.range(1).select(*(closed(F.lit((1 << 3) | (1 << (3 + d))).cast("long"), reach).alias(f"d{d}") for d in range(1, 20))).first()
    for d in range(1, 20):
        full = sum(1 << (3 + i) for i in range(d + 1))
        assert row[f"d{d}"] == (full if d <= reach else (1 << 3) | (1 << (3 + d)))


def test_earliest_takes_usable_times(spark):
    rows = [(1, 5, 30), (1, 5, 20), (1, None, 10), (1, 5, 0), (1, 5, None), (None, 5, 1), (2, 8, 40), (2, 7, 40), (3, None, 9)]
    df = spark.createDataFrame(rows, "ev long, client long, us long")
    assert sorted(tuple(r) for r in earliest(df, "ev", "client", "us").collect()) == [(1, 5, 20), (2, 7, 40)]
