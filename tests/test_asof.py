import random
from datetime import date, timedelta

from tickloom.operators.asof_versions import asof_versions

D0 = date(2020, 1, 1)
EVENTS = "event_id long, client long, day date, us long, entity string, version_id int"
VERSIONS = "vid long, client long, a date, b date, known long, bucket int"


def got(spark, events, versions, rows=60_000):
    e = spark.createDataFrame([(*r, "x", 1) for r in events], EVENTS)
    v = spark.createDataFrame([(*r, 3) for r in versions], VERSIONS)
    out = asof_versions(e, v, event_id="event_id", entity="client", day="day", ts_us="us", version_id="vid", effective_from="a", effective_to="b", known_us="known", bucket_rows=rows)
    return sorted(((r[0], r[1], r[2], r[3], r[4]) for r in out.collect()), key=str)


def brute(events, versions):
    out = []
    for i, c, d, t in events:
        fit = [(a, k, v) for v, vc, a, b, k in versions if None not in (c, d, t, a, k) and vc == c and a <= d and (b is None or d < b) and k <= t]
        out.append((i, c, d, t, max(fit)[2] if fit else None))
    return sorted(out, key=str)


def test_against_brute_force_with_a_hot_client(spark):
    rng = random.Random(3)
    day = lambda: D0 + timedelta(days=rng.randrange(30))
    events = [(i, 1 if rng.random() < 0.5 else rng.randrange(2, 12), day(), rng.randrange(1000)) for i in range(900)]
    events += [(5000, None, D0, 5), (5001, 1, None, 5), (5002, 1, D0, None), (5003, 77, D0, 5), events[0], events[0]]
    versions = [(v, 1 if v % 3 == 0 else rng.randrange(1, 12), day(), rng.choice([None, day(), date(9999, 12, 31)]), rng.choice([None, rng.randrange(900)])) for v in range(200)]
    versions += [versions[3], (900, None, D0, None, 1), (901, 1, None, None, 1)]
    want = brute(events, versions)
    assert got(spark, events, versions) == want
    assert got(spark, events, versions, rows=50) == want  # the hot client over many buckets


def test_ties_go_to_later_start_then_later_record_then_larger_id(spark):
    v = [(1, 1, D0, None, 10), (2, 1, D0, None, 10), (3, 1, D0, None, 9), (4, 1, D0 - timedelta(1), None, 11)]
    assert got(spark, [(1, 1, D0, 20)], v) == [(1, 1, D0, 20, 2)]


def test_what_becomes_known_later_is_not_used(spark):
    assert got(spark, [(1, 1, D0, 9), (2, 1, D0, 10)], [(1, 1, D0, None, 10)]) == [(1, 1, D0, 9, None), (2, 1, D0, 10, 1)]


def test_empty_tables(spark):
    assert got(spark, [], [(1, 1, D0, None, 10)]) == []
    assert got(spark, [(1, 1, D0, 9)], []) == [(1, 1, D0, 9, None)]


def test_many_versions_of_one_entity_are_spread(spark):
    rng = random.Random(5)
    day = lambda: D0 + timedelta(days=rng.randrange(4))
    events = [(i % 60, 1, day(), rng.randrange(2000)) for i in range(80)]
    versions = [(v, 1, D0 - timedelta(days=rng.randrange(9)), rng.choice([None, day()]), rng.randrange(2000)) for v in range(1500)] + [(v, 2, D0, None, 1) for v in range(5000, 5400)]
    assert got(spark, events, versions, rows=100) == brute(events, versions)
