import random
from collections import Counter

import pytest

from tickloom.llm.packing import pack, placements

SCHEMA = "doc long, n int, item string, pack_id int, part_no int"


def packed(spark, rows, capacity):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in pack(df, "doc", "n", capacity).collect()]


def check(rows, out, capacity):
    whole = Counter()
    for doc, _, _, n, _, _ in out:
        whole[doc] += n
    want = Counter()
    for doc, n in rows:
        want[doc] += n or 0
    assert whole == want
    used = {}
    for _, _, _, n, p, at in out:
        if p is not None:
            used.setdefault(p, []).append((at, n))
    for parts in used.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[-1][0] + parts[-1][1] <= capacity
    assert sorted(used) == list(range(len(used)))
    return len(used)


def test_everything_is_packed_once_and_tightly(spark):
    rng = random.Random(9)
    rows = [(i, min(5000, int(rng.lognormvariate(5, 1)) + 1)) for i in range(3000)] + [(i, 77) for i in range(5000, 6000)]
    rows += [(7000, 12345), (7001, 2048), (7002, 4096)]
    out = packed(spark, rows, 2048)
    assert check(rows, out, 2048) <= 1.01 * sum(n for _, n in rows) / 2048 + 1
    parts = Counter(doc for doc, *_ in out)
    assert all(parts[doc] == max(1, -(-n // 2048)) for doc, n in rows)


def test_one_length_fills_containers():
    got = placements({100: 1000}, 2048)
    assert max(first + end - begin for _, begin, end, first, _ in got) == 50


def test_nulls_empty_texts_and_repeats(spark):
    rows = [(1, 5), (1, 5), (2, None), (3, 0), (None, 4)]
    out = packed(spark, rows, 10)
    check(rows, out, 10)
    assert sorted((d or 0, n, p is None) for d, _, _, n, p, _ in out) == [(0, 4, False), (1, 5, False), (1, 5, False), (2, 0, True), (3, 0, True)]


def test_no_items(spark):
    assert packed(spark, [], 10) == []
    with pytest.raises(ValueError):
        packed(spark, [], 0)


def test_placements_are_few_for_many_items():
    rng = random.Random(1)
    assert len(placements({n: rng.randrange(1, 10**7) for n in range(1, 2049)}, 2048)) < 60_000
