import math
import os
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom import queries_vectors
from tickloom.functions import counter_rng as R
from tickloom.functions import vectors as V
from tickloom.operators import attributes as A
from tickloom.operators import choice as C
from tickloom.operators import grid as G
from tickloom.operators import recovery as M
from tickloom.operators import summary as S
from tickloom.sources import layout as L
from tickloom.streaming import tape as T


def test_generator_gives_the_published_words(spark):
    words = spark.range(1).select(R.philox(F.col("id"))).first()[0]
    assert [f"{w:08X}" for w in words] == ["6627E8D5", "E169C58D", "BC57AC4C", "9B00DBD8"]


def test_draws_follow_their_weights(spark):
    u = R.uniform(R.philox(F.col("id"), 1)[0])
    weights = F.array(*(F.lit(float(w)) for w in (6, 0, 1, 3)))
    got = {r[0]: r[1] / 20_000 for r in spark.range(20_000).select(R.categorical(u, weights).alias("i")).groupBy("i").count().collect()}
    assert all(abs(got.get(i, 0) - p) < 0.015 for i, p in enumerate((0.6, 0, 0.1, 0.3)))
    assert [r[0] for r in spark.range(1).select(R.categorical(F.lit(0.5), F.array(F.lit(0.0)))).collect()] == [-1]
    a, b = R.normal_pair(R.philox(F.col("id"), 2))
    mean, std, corr = spark.range(20_000).select(a.alias("a"), b.alias("b")).agg(F.avg("a"), F.stddev("b"), F.corr("a", "b")).first()
    assert abs(mean) < 0.03 and abs(std - 1) < 0.03 and abs(corr) < 0.03


def test_poisson_counts_have_no_greatest_value(spark):
    u = R.uniform(R.philox(F.col("id"), 3)[0])
    for mean in (0.5, 40.0, 174.0, 300.0, 2_000.0, 1_000_000.0):
        rows = 1_000 if mean > 10_000 else 4_000
        got = spark.range(rows).select(R.poisson(u, F.lit(mean)).alias("k")).agg(F.avg("k"), F.var_samp("k")).first()
        assert abs(got[0] - mean) < 5 * math.sqrt(mean / rows) and abs(got[1] / mean - 1) < 0.25
    edges = spark.createDataFrame([(0.0, 0.3), (None, 0.3), (3.0, None), (-1.0, 0.3), (math.inf, 0.3), (math.nan, 0.3), (3.0, 1 - 2.0**-33), (3.0, 2.0**-33)], "m double, u double")
    assert [r[0] for r in edges.select(R.poisson(F.col("u"), F.col("m"))).collect()] == [0, None, None, None, None, None, 19, 0]  # 1 - cdf(18) = 5e-10 and 1 - cdf(19) = 8e-11


def test_poisson_counts_equal_the_inverse_distribution(spark):
    rows = [(m, (i + 0.5) / 50) for m in (3.0, 64.0, 700.0, 900.0) for i in range(50)]
    want = []
    for m, u in rows:
        k, cdf = 0, math.exp(-m)
        while u > cdf:
            k += 1
            cdf += math.exp(k * math.log(m) - m - math.lgamma(k + 1))
        want.append(k)
    df = spark.createDataFrame(rows, "m double, u double").coalesce(1)
    assert [r[0] for r in df.select(R.poisson(F.col("u"), F.col("m"))).collect()] == want


def test_partition_and_softmax_draw(spark):
    rows = [(1, i, math.log(w), i != 3) for i, w in enumerate((5, 1, 2, 50, 8))] + [(2, 0, 0.0, False), (3, 0, None, True)]
    df = spark.createDataFrame(rows, "g long, c long, logit double, ok boolean")
    got = {r["g"]: r for r in C.log_partition(df, "g", F.col("logit"), F.col("ok")).collect()}
    assert abs(math.exp(got[1]["log_z"]) - 16) < 1e-9 and (got[1]["n_candidates"], got[1]["n_masked"]) == (4, 1)
    assert got[2]["log_z"] == got[3]["log_z"] == -math.inf
    many = spark.range(4000).crossJoin(F.broadcast(df.where("g = 1").drop("g")))  # repetitions of a small fixture
    u = R.uniform(R.philox(F.col("id") * 8 + F.col("c"), 4)[0])
    share = {r[0]: r[1] / 4000 for r in C.softmax_draw(many, "id", "c", F.col("logit"), F.col("ok"), u).groupBy("chosen").count().collect()}
    assert all(abs(share.get(i, 0) - p) < 0.04 for i, p in enumerate((5 / 16, 1 / 16, 2 / 16, 0, 8 / 16)))


INSTRUMENTS = "instrument_id long, issue_date date, maturity_date date, coupon double, amount double, rating int, seniority int, sector int, on_the_run boolean, in_index boolean, is_144a boolean, is_financial boolean"


def test_features_of_instruments(spark):
    asof = F.lit("2030-03-01").cast("date")
    rows = [
        (1, date(2020, 3, 1), date(2035, 3, 2), 4.5, 2e9, 4, 2, 1, True, False, None, True),
        (2, date(2031, 1, 1), date(2029, 1, 1), 0.0, 0.0, 11, 0, 0, False, True, True, False),
        (3, None, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], INSTRUMENTS + ", feature string, value int")
    got = {(r["instrument_id"], r["feature"]): r["value"] for r in A.features(df, asof, ["a", "b"]).collect()}
    assert len(got) == 3 * len(A.names(["a", "b"])) and {got[3, n] for n in A.names(["a", "b"])} == {None}
    of = lambda i: {n: got[i, n] for n in A.names(["a", "b"])}
    one, two = of(1), of(2)
    left = 1827 / 365.25
    assert abs(one["log1p_age"] - math.log1p(3652 / 365.25)) < 1e-12 and abs(one["log1p_ttm"] - math.log1p(left)) < 1e-12
    assert abs(one["tenor_rbf_7"] - math.exp(-((math.log1p(left) - math.log(8)) ** 2) / (2 * 0.35**2))) < 1e-12 and one["tenor_rbf_5"] > 0.999
    assert abs(one["log_size_s"] - (math.log10(2e9) - 8) / 2) < 1e-12 and (one["coupon_s"], one["rating_unit"], one["seniority_s"]) == (0.45, 3 / 21, 2 / 3)
    assert (one["is_hy"], one["is_otr"], one["in_index"], one["is_144a"], one["is_financial"], one["sector_a"], one["sector_b"]) == (0, 1, 0, None, 1, 0, 1)
    assert (two["log1p_age"], two["log1p_ttm"], two["log_size_s"], two["is_hy"], two["sector_a"]) == (0, 0, -4, 1, 1)
    with pytest.raises(Exception, match="no such sector: 1"):
        A.features(df, asof, ["a"]).collect()
    assert A.features(df.where("false"), asof, ["a"]).count() == 0


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_standard_features_send_means_rather_than_rows(spark, tmp_path, threshold):
    sizes = [1, 2, 3, 10, 50, None]
    spark.createDataFrame([(i, f"Brand#{i}", size, 900.0) for i, size in enumerate(sizes)], "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        out = queries_vectors.standard_features(spark, str(tmp_path))
        plan = out._jdf.queryExecution().sparkPlan().toString()
        got = {(r["instrument_id"], r["feature"]): r["value"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert len(got) == len(sizes) * len(A.names([]))
    assert [got[i, "is_144a"] for i in range(6)] == [0, 1, 0, 1, 1, None] and {got[i, "coupon_s"] for i in range(6)} == {0.0}
    seniority = [size % 4 / 3 for size in sizes[:-1]]
    assert [got[i, "seniority_s"] for i in range(5)] == [round(float(x), 4) for x in (seniority - np.mean(seniority)) / np.std(seniority)] and got[5, "seniority_s"] is None


def test_best_two(spark):
    df = spark.createDataFrame([(1, 5.0, 2), (1, 5.0, 1), (1, 7.0, 3), (2, 1.0, 1), (2, None, 0), (3, None, 1)], "g long, v double, s long")
    assert sorted(tuple(r) for r in C.best_two(df, "g", "v", "s").collect()) == [(1, 1, 5.0, 2, 5.0, 3), (2, 1, 1.0, None, None, 1)]


def vectors(spark, n=60, d=6):
    rng = np.random.default_rng(3)
    a = rng.standard_normal((n, d))
    b = a @ rng.standard_normal((d, d)) + rng.standard_normal((n, d))
    c = rng.standard_normal((n, d))
    return a, b, c, spark.createDataFrame([(x.tolist(), y.tolist(), z.tolist()) for x, y, z in zip(a, b, c)] + [(None, [1.0] * d, [1.0] * d)], "a array<double>, b array<double>, c array<double>")


def test_gram_correlations_equal_those_over_all_pairs(spark):
    a, b, c, df = vectors(spark)
    off = ~np.eye(len(a), dtype=bool)
    grams = {n: (m @ m.T)[off] for n, m in (("a", a), ("b", b), ("c", c))}
    got = M.gram_correlations(df.repartition(5), ["a", "b", "c"])
    for (x, y), r in got.items():
        assert abs(r - np.corrcoef(grams[x], grams[y])[0, 1]) < 1e-9
    assert math.isnan(M.gram_correlations(df.where("false"), ["a", "b"])["a", "b"])
    assert abs(M.gram_correlations(df, ["a", "a"])["a", "a"] - 1) < 1e-9


def test_axes_and_canonical_correlations(spark):
    a, b, c, df = vectors(spark, 2000)
    assert abs(M.top_axes_alignment(df, "a", "a", 3) - 1) < 1e-9
    rotated = df.select("a", F.transform("a", lambda x: x * 3.0).alias("r"), "c")
    assert min(M.canonical_correlations(rotated, "a", "r")) > 0.999 and max(M.canonical_correlations(rotated, "a", "c")) < 0.2
    assert M.canonical_correlations(df.where("false"), "a", "b") == []
    assert M.partial_correlation(0.5, 1.0, 0.5) == 0


def test_mean_vectors_skip_unusable_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [3.0, 4.0]), (1, None), (1, [float("nan"), 1.0]), (None, [1.0, 1.0]), (2, [None, 1.0])]
    assert [tuple(r) for r in M.mean_vectors(spark.createDataFrame(rows, "k long, v array<float>"), "k", "v").collect()] == [(1, [2.0, 3.0])]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [math.log(1), math.log(3)])], "a array<double>, z array<double>, l array<double>")
    got = df.select(V.norm(F.col("a")), V.unit(F.col("z")), V.cosine(F.col("a"), F.col("a")), V.l1_distance(F.col("a"), F.col("z")), V.log_sum_exp(F.col("l"))).first()
    assert got[0] == 5 and got[1] == [0, 0] and abs(got[2] - 1) < 1e-12 and got[3] == 7 and abs(got[4] - math.log(4)) < 1e-12


def test_summaries(spark):
    counts = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10, 0)], "n double")
    x = np.array([1, 2, 3, 10.0])
    want = ((2 * np.arange(1, 5) - 5) * x).sum() / (4 * x.sum())
    assert abs(S.gini(counts).first()["gini"] - want) < 1e-12
    assert tuple(S.gini(counts.where("false")).first()) == (0, None)
    rows = spark.createDataFrame([(1, -1.0, 4), (2, -3.0, 1), (3, float("nan"), 2), (4, None, 2), (5, float("-inf"), 8)], "k long, lp double, c long")
    floor = S.mean_loss(rows, F.col("lp"), F.col("c")).first()
    assert (floor["n"], floor["floor_nats"]) == (2, 2.0) and abs(floor["uniform_nats"] - math.log(4) / 2) < 1e-12
    assert abs(S.excess_loss(rows, rows, "k", "lp", "lp").first()["excess_nats"]) < 1e-12


def test_grid(spark):
    rows = spark.createDataFrame([(1, t, s) for t, s in enumerate("aabba")] + [(2, 0, None), (2, 1, None)], "k long, t long, s string")
    got = sorted(tuple(r) for r in G.sojourns(rows, ["k"], ["t"], "t", "s").collect())
    assert got == [(1, 0, "a", 0, 2, 2), (1, 1, "b", 2, 4, 2), (1, 2, "a", 4, None, 1), (2, 0, None, 0, None, 2)]
    walk = spark.createDataFrame([(1, i, [float(i), 0.0]) for i in range(6)], "d long, s long, v array<double>")
    drift = G.rolling_drift(G.steps(walk, "d", "s", "v"), "d", "s", 3)
    assert [r["drift"] for r in drift.orderBy("s").collect()] == [3.0, 3.0, 3.0]
    assert G.drift_summary(drift.where("false")).first()["n"] == 0


def test_grid_counts_keep_lines_outside_the_frame(spark):
    rows = spark.createDataFrame([(1, 3), (1, 3), (1, 8), (2, 25), (2, None), (None, 8)], "d long, s long")
    got = sorted(tuple(r) for r in G.grid_counts(rows, "d", F.col("s"), 7, 9).collect())
    assert got == [(1, 3, 2), (1, 7, 0), (1, 8, 1), (1, 9, 0), (2, 7, 0), (2, 8, 0), (2, 9, 0), (2, 25, 1)]


def test_levels_of_a_long_tape_equal_the_recursion(spark):
    days = [*range(0, 2500, 7), 9000, 9001]
    df = spark.createDataFrame([(k, d, float(1 + d % 5)) for k in (1, 2) for d in days], "k long, d int, x double").withColumn("day", F.date_add(F.lit("2000-01-01").cast("date"), F.col("d")))
    for phi in (0.5, 0.999, 0.01):
        want, level, last = [], 0.0, 0
        for d in days:
            level, last = level * phi ** (d - last) + 1 + d % 5, d
            want.append(level)
        got = [r["level"] for r in G.decayed_level(df, "k", F.col("day"), F.col("x"), phi).where("k = 2").orderBy("day").collect()]
        assert np.allclose(got, want, rtol=1e-9, atol=0)


def test_layout_round_trip_and_tampering(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2026-0{1 + i % 2}-10") for i in range(7)], "event_id long, day string").withColumn("day", F.to_date("day"))
    path = str(tmp_path / "tape")
    L.write_monthly(df, path, "day", ["event_id"])
    back = spark.read.parquet(path)
    assert back.count() == 7 and {r[0] for r in back.select(F.col("trade_month").cast("string")).distinct().collect()} == {"2026-01", "2026-02"}
    recorded = spark.createDataFrame(L.inventory(spark, path).collect())
    assert L.mismatches(recorded, L.inventory(spark, path)).count() == 0
    file = next(os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))
    os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    with open(file, "ab") as f:
        f.write(b"x")
    assert [r["problem"] for r in L.mismatches(recorded, L.inventory(spark, path)).collect()] == ["size"]
    os.remove(file)
    assert [r["problem"] for r in L.mismatches(recorded, L.inventory(spark, path)).collect()] == ["missing"]


def test_streams_hold_a_day_of_a_key_at_a_time(spark, tmp_path, monkeypatch):
    day = 86_400_000_000
    rows = [(i, 1 if i % 3 else 2, (i * 7919 % 400) * day // 100) for i in range(300)] + [(900, 3, -5), (901, None, 5), (902, 1, None)]
    spark.createDataFrame(rows, "event_id long, user_id long, us long").select("event_id", "user_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    widest = []
    drained = T.drained

    def watched(stream, mode):
        out = drained(stream, mode)
        widest.append((out.columns, out.groupBy("key", "day").count().agg(F.max("count")).first()[0]))
        return out

    monkeypatch.setattr(T, "drained", watched)
    gaps, blocks = {}, {}
    for user in (1, 2, 3):
        order = sorted((us, i) for i, u, us in rows if u == user and us is not None)
        for k, (us, i) in enumerate(order):
            gaps[i], blocks[i] = us - order[k - 1][0] if k else None, k // 64
    assert {r["event_id"]: r["gap_us"] for r in queries_vectors.stream_gaps(spark, str(tmp_path)).collect()} == gaps
    assert {r["event_id"]: r["block"] for r in queries_vectors.stream_blocks(spark, str(tmp_path)).collect()} == blocks
    assert len(widest) == 2 and all(n <= 60 for _, n in widest)


def test_stream_gaps_equal_the_batch_whatever_order_files_come_in(spark, tmp_path):
    day = 86_400_000_000
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(1, 4)), int(rng.integers(0, 3 * day)) // 10**9 * 10**9) for i in range(240)]
    rows += rows[:9]  # delivered again
    files = [sorted(rows[120:200], key=lambda r: -r[2]), rows[:80], rows[200:], rows[80:120]]
    for part in files:
        df = spark.createDataFrame(part, "event_id long, user_id long, us long").select("event_id", "user_id", F.timestamp_micros("us").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    stream = T.stream_table(spark, str(tmp_path), "events", files_per_batch=1)
    drained = T.drained(T.day_gaps(stream, "user_id", "ts", "event_id"), "append")
    assert drained.agg(F.max("version")).first()[0] >= 2
    got = sorted((r["key"], r["item"], r["gap_us"] is None, r["gap_us"] or 0) for r in T.gaps(drained).collect())
    want = []
    for user in (1, 2, 3):
        order = sorted((us, i) for i, u, us in rows if u == user)
        want += [(user, i, k == 0, us - order[k - 1][0] if k else 0) for k, (us, i) in enumerate(order)]
    assert got == sorted(want)


def test_clock_after_the_last_session(spark):
    day = 86_400_000_000
    calendar = spark.createDataFrame([(date(1970, 1, 3), 2 * day + 100, 2 * day + 400), (date(1970, 1, 6), 5 * day + 100, 5 * day + 600)], "trade_date date, open_us long, close_us long")
    times = {0: 0, 2 * day + 150: 50, 4 * day: 300, 5 * day + 300: 500, 6 * day: 800, 800 * day: 800}
    events = spark.createDataFrame([(t,) for t in times], "ts_us long")
    assert {r["ts_us"]: r["session_us"] for r in G.session_clock(events, calendar).collect()} == times
    assert {r["session_us"] for r in G.session_clock(events, calendar.where("false")).collect()} == {0}


def test_parts_of_a_geometry(spark):
    rng = np.random.default_rng(9)
    attribute = np.zeros((300, 6))
    attribute[:, :2] = 3 * rng.standard_normal((300, 2))
    full = attribute + rng.standard_normal((300, 6))
    df = spark.createDataFrame([(a.tolist(), (f - a).tolist(), (2 * f).tolist()) for a, f in zip(attribute, full)], "a array<double>, r array<double>, f array<double>")
    centred = full - full.mean(axis=0)
    assert abs(M.subspace_share(df, "a", "f", 2) - (centred[:, :2] ** 2).sum() / (centred**2).sum()) < 1e-9
    assert abs(M.subspace_share(df, "a", "f", 6) - 1) < 1e-9 and math.isnan(M.subspace_share(df.where("false"), "a", "f", 2))
    assert M.checked_parts(df, "a", "r", "f").count() == 300
    with pytest.raises(Exception, match="do not add up"):
        M.checked_parts(df.withColumn("r", F.transform("r", lambda x: x + 0.1)), "a", "r", "f").collect()


def test_manifest_keeps_its_version(spark, tmp_path):
    df = spark.createDataFrame([(i, date(2031, 1 + i % 2, 3)) for i in range(50)], "i long, d date")
    L.write_monthly(df, f"{tmp_path}/t", "d", ["i"])
    L.write_manifest(spark, f"{tmp_path}/t", f"{tmp_path}/m", "7")
    assert L.read_manifest(spark, f"{tmp_path}/m", "7").agg(F.sum("n_rows")).first()[0] == 50
    assert L.mismatches(L.read_manifest(spark, f"{tmp_path}/m", "7"), L.inventory(spark, f"{tmp_path}/t")).count() == 0
    with pytest.raises(Exception, match="schema version is not 8: 7"):
        L.read_manifest(spark, f"{tmp_path}/m", "8").collect()


def test_gini_of_equal_and_odd_values(spark):
    df = spark.createDataFrame([(3.0,)] * 500 + [(None,), (float("nan"),), (0.0,), (-2.0,)], "n double")
    assert tuple(S.gini(df).first()) == (500, 0.0)
    assert abs(S.gini(spark.createDataFrame([(1.0,)] * 99 + [(101.0,)], "n double")).first()["gini"] - 0.495) < 1e-12


def test_event_ids(spark):
    row = spark.range(1).select(L.event_id(F.lit(5), F.lit(77)).alias("i")).select("i", L.shard_of(F.col("i")), L.counter_of(F.col("i"))).first()
    assert tuple(row) == ((5 << 48) + 77, 5, 77)


def test_stream_places_count_on_over_files_and_buckets(spark, tmp_path):
    rows = [(i, i % 5 if i % 2 else 0, 1000 * i) for i in range(200)]
    for part in (rows[:90], rows[90:]):
        df = spark.createDataFrame(part, "event_id long, user_id long, us long").select("event_id", "user_id", F.timestamp_micros("us").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    for buckets in (1, 3):
        stream = T.stream_table(spark, str(tmp_path), "events", files_per_batch=1)
        places = T.drained(T.day_places(stream, "user_id", "ts", "event_id", buckets), "append").collect()
        assert len(places) == 200
        for user in range(5):
            assert sorted(r["place"] for r in places if r["key"] == user) == list(range(sum(u == user for _, u, _ in rows)))
