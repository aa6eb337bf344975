import random

import pytest

from tickloom.llm.splitting import bisection, greedy, split_sequences

SCHEMA = "seq_id long, tokens array<int>, piece_no string, piece_start string"


def pieces(spark, rows, *args):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted((r["seq_id"], r["piece_start"], r["piece_end"]) for r in split_sequences(df, "seq_id", "tokens", *args).collect())


def brute(t, limit, overlap):
    content = [i for i, x in enumerate(t) if x not in (None, 0, 1, 2)]
    if len(content) <= limit:
        return []
    out, s, e0, reached = [], content[0], content[-1] + 1, content[0]
    lines = [i for i in content if t[i] in (3, 4)]
    while e0 - s > limit:
        found = [i for i in content if t[i] == 3 and reached < i <= s + limit] or [i for i in lines if reached < i <= s + limit]
        e = found[-1] if found else s + limit
        out.append((s, e))
        s, reached = next((i for i in lines if i > s and i >= e - overlap and i <= e), e), e
    return [*out, (s, e0)]


def sequence(rng, n, packages=0.3):
    t = [1]
    while len(t) < n:
        t += [3] + [9] * 6 if rng.random() < packages else [4, 9, 9]
    return t + [2] * rng.randrange(2) + [0] * rng.randrange(4)


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, sequence(rng, rng.choice([5, 40, 41, 60, 500]), rng.choice([0, 0.02, 0.3, 1]))) for i in range(60)]
    want = sorted((i, *p) for i, t in rows for p in brute(t, 40, 8))
    assert pieces(spark, rows + rows[:5], 40, 8) == want  # repeated rows give their pieces once


def test_no_boundary_nulls_and_lost_arrays(spark):
    rows = [(1, [9] * 100), (2, None), (None, [9] * 100), (3, []), (4, [1, None, *[9] * 50, 2])]
    assert pieces(spark, rows, 40, 8) == [(1, 0, 40), (1, 40, 80), (1, 80, 100), (4, 2, 42), (4, 42, 52)]
    assert pieces(spark, [], 40, 8) == []


def test_very_long_sequence(spark):
    rng = random.Random(4)
    t = sequence(rng, 300_000)
    got = pieces(spark, [(1, t)], 254, 24)
    assert [p[1:] for p in got] == brute(t, 254, 24)


def test_bisection_covers_and_bounds(spark):
    rng = random.Random(6)
    for packages in (0, 0.3, 1):
        t = sequence(rng, 900, packages)
        got = [p[1:] for p in pieces(spark, [(1, t)], 100, 16, bisection)]
        assert all(0 < e - s <= 100 for s, e in got)
        assert all(b[0] <= a[1] <= b[1] and a[1] - b[0] <= 16 for a, b in zip(got, got[1:]))
        assert all(t[s] in (3, 4) for s, _ in got)
    assert pieces(spark, [(1, [9] * 100)], 40, 8, bisection)[0][1:] == (0, 25)


def test_overlaps_and_kinds_of_ends(spark):
    rng = random.Random(8)
    rows = [(i, sequence(rng, 700, p)) for i, p in enumerate((0, 0.3, 1))] + [(9, [9] * 100)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    tokens = dict(rows)
    for plan in (greedy, bisection):
        last = {}
        for r in split_sequences(df, "seq_id", "tokens", 60, 12, plan).orderBy("seq_id", "piece_no").collect():
            t, before = tokens[r["seq_id"]], last.get(r["seq_id"])
            assert r["piece_no"] == (before["piece_no"] + 1 if before else 0) and r["overlap"] == (before["piece_end"] - r["piece_start"] if before else 0) <= 12
            after = [i for i in range(r["piece_end"], len(t)) if t[i] > 2]
            assert r["end_kind"] == ("end" if not after else {3: "package", 4: "line"}.get(t[r["piece_end"]], "inside"))
            last[r["seq_id"]] = r
        assert {i for i, r in last.items() if r["end_kind"] == "end"} == set(tokens)


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        pieces(spark, [], 10, 10)
