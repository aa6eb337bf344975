import random
from collections import Counter
from datetime import datetime, timedelta, timezone
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from tickloom import queries_tape
from tickloom.operators import classes as C
from tickloom.operators import dictionary as D
from tickloom.operators import disclosure as P
from tickloom.operators.blocks import DEALER_EDGES, edge_bucket, gap_bucket
from tickloom.operators.packages import sentences, window_pair_counts
from tickloom.operators.sequences import anchor_positions, fixed_context, greedy_sequences, mixture_plan
from tickloom.operators.tape_windows import tape_windows
from tickloom.plans.chains import begins
from tickloom.plans.neighbours_in_time import previous_time
from tickloom.plans.ranking import rank_in_group, running_total

START = datetime(2031, 6, 2, 8, 30, tzinfo=timezone.utc)
# Every way an enquiry can look, show and end: (disclosed, true, outcome, result), a two-way being of either true side.
WAYS = [(shown, true, outcome, result) for shown, true in ((0, 0), (1, 1), (2, 0), (2, 1)) for outcome, result in product(range(4), range(6))]


def line(i, shown, true, outcome, result, **changes):
    ts = START + timedelta(seconds=97 * i)
    row = dict.fromkeys(C.TAPE) | {
        "event_id": 1000 + i, "package_id": 1000 + i - i % 3, "line_no": i % 3, "n_lines": 3, "package_type": 1, "ts": ts, "trade_date": ts.date(), "client_id": 40 + i // 3 % 5, "instrument_id": 500 + i % 11, "token_id": 9000 + i,
        "client_side_disclosed": shown, "client_side_true": true, "our_in_panel": True, "received": result != 5, "enquiry_outcome": outcome, "our_result": result, "outcome_ts": ts + timedelta(minutes=4), "qty_par": 250_000 * (i + 1), "n_dealers": 3,
    }
    if outcome == P.TRADED:
        row |= {"exec_px": 101 + i / 8, "exec_sprd_bp": 40.0 + i, "cover_px": 100 + i / 8, "cover_sprd_bp": 41.0 + i}
    return row | changes


def tape(spark, rows=None):
    rows = [line(i, *way) for i, way in enumerate(WAYS)] if rows is None else rows
    return spark.createDataFrame([tuple(r[c] for c in C.TAPE) for r in rows], ", ".join(f"{c} {C.TYPES[c]}" for c in C.TAPE))


EVERY_SIDE = P.Policy(sides_of_trades=frozenset(range(6)), sides_of_others=frozenset({1, 2, 3}), cover_shown_to=frozenset({0, 1, 2}), prints=True, lag_us=1_500_000)
POLICIES = [P.DEFAULT, P.STRICT, EVERY_SIDE, P.Policy(sides_of_others=frozenset({3})), P.Policy(cover_shown_to=frozenset({1, 4}))]


def allowed(policy, outcome, result):
    """(side, execution, cover) that a policy shows at this end of an enquiry."""
    side = result in policy.sides_of_trades if outcome == P.TRADED else outcome in policy.sides_of_others
    return side, outcome == P.TRADED and (policy.prints or result == P.WON), outcome == P.TRADED and result in policy.cover_shown_to


@pytest.mark.parametrize("policy", POLICIES)
def test_views_show_what_their_policy_allows(spark, policy):
    view = P.observable(tape(spark), policy)
    assert view.columns == C.contract() and not {"token_id", "client_side_true", "received"} & set(view.columns)
    got = {r["event_id"] - 1000: r for r in view.collect()}
    assert got.keys() == {i for i, way in enumerate(WAYS) if way[3] != 5}
    for i, r in got.items():
        shown, true, outcome, result = WAYS[i]
        side, execution, cover = allowed(policy, outcome, result)
        asked = START + timedelta(seconds=97 * i)
        when = r["side_reveal_ts"].astimezone(timezone.utc) if r["side_reveal_ts"] else None
        if shown != P.TWO_WAY:
            assert (r["side_revealed"], when) == (shown, asked)
        else:
            assert (r["side_revealed"], when) == ((true, asked + timedelta(minutes=4, microseconds=policy.lag_us)) if side else (None, None))
        assert r["exec_px"] == (101 + i / 8 if execution else None) and r["cover_sprd_bp"] == (41.0 + i if cover else None)


def test_audits_count_what_a_policy_does_not_allow(spark):
    view = P.observable(tape(spark), EVERY_SIDE)
    for policy in POLICIES:
        ends = [(way, allowed(policy, *way[2:]), allowed(EVERY_SIDE, *way[2:])) for way in WAYS if way[3] != 5]
        found = {r["rule"]: r["n_rows"] for r in P.audit(view, policy).collect()}
        assert found.pop("two_way_side_shown") == sum(way[0] == P.TWO_WAY and was[0] and not may[0] for way, may, was in ends)
        assert found.pop("execution_shown") == sum(was[1] and not may[1] for _, may, was in ends)
        assert found.pop("cover_shown") == sum(was[2] and not may[2] for _, may, was in ends)
        assert set(found.values()) == {0}
    early = view.withColumn("side_reveal_ts", F.col("side_reveal_ts") - F.expr("INTERVAL 1 HOUR"))
    found = {r["rule"]: r["n_rows"] for r in P.audit(early, EVERY_SIDE).collect()}
    assert found["reveal_before_request"] == view.where("side_revealed IS NOT NULL").count()


def test_invariants_and_contract(spark):
    rows = [line(i, *way) for i, way in enumerate(WAYS)]
    rows[3] |= {"our_in_panel": False}
    rows[5] |= {"our_in_panel": False}  # not received
    rows[30] |= {"client_side_true": 0}
    bad = tape(spark, rows)
    assert {r["rule"]: r["n_rows"] for r in P.invariants(bad).collect()} == {"received_off_panel": 1, "disclosed_side_differs": 1}
    with pytest.raises(C.ContractError):
        P.observable(bad.withColumn("hedge", F.lit(1)))
    view = P.observable(tape(spark))
    moved = view.select(*view.columns[1:], view.columns[0])
    for other in (view.withColumn("received", F.lit(True)), view.drop("exec_px"), view.withColumnRenamed("ts", "time"), moved, view.withColumn("exec_px", F.col("exec_px").cast("float"))):
        with pytest.raises(C.ContractError):
            P.audit(other)
    assert C.with_classes(bad.schema)["our_in_panel"].metadata["class"] == C.SELECTOR
    assert P.observable(bad.where("false")).count() == 0


def test_sentences(spark):
    rows = tape(spark).withColumn("ts_us", F.unix_micros("ts"))
    got = {r["package_id"]: r for r in sentences(rows).collect()}
    assert {p: r["tokens"] for p, r in got.items()} == {1000 + p: [9000 + p, 9001 + p, 9002 + p] for p in range(0, len(WAYS), 3)}
    assert {r["n_clients"] for r in got.values()} == {1} and got[1006]["client_id"] == 42
    assert {r["n_clients"] for r in sentences(rows.withColumn("client_id", F.col("event_id"))).collect()} == {3}


def test_multi_author_packages_gather_no_group(spark, tmp_path):
    rows = [line(i, 0, 0, 0, 0, instrument_id=n, client_id=c) for i, (n, c) in enumerate([(70, 1), (70, 2), (70, 1), (71, 1), (None, 3), (None, 4), (71, None)])]
    tape(spark, rows).write.parquet(f"{tmp_path}/rfq_lines.parquet")
    out = queries_tape.multi_author_packages(spark, str(tmp_path))
    assert {r["instrument_id"]: (r["n_clients"], r["n_lines"]) for r in out.collect()} == {70: (2, 3), None: (2, 2)}
    assert "collect_list" not in out._jdf.queryExecution().toString()


def test_all_contexts_drop_no_token(spark, tmp_path):
    spark.createDataFrame([(i, [1] * n) for i, n in enumerate((0, 1, 256, 257, 700))] + [(9, None)], "seq_id long, tokens array<int>").write.parquet(f"{tmp_path}/packed_corpus.parquet")
    got = sorted((r["seq_id"], r["context_no"], r["n_kept"], r["input_sum"]) for r in queries_tape.all_contexts(spark, str(tmp_path)).collect())
    assert got == [(i, k, n, n) for i, k, n in [(0, 0, 0), (1, 0, 1), (2, 0, 256), (3, 0, 256), (3, 1, 1), (4, 0, 256), (4, 1, 256), (4, 2, 188)]]


@pytest.mark.parametrize("window", [2, 9, 500])
def test_pair_counts_against_brute_force(spark, window):
    rng = random.Random(window)
    rows = [(rng.randrange(6), rng.choice([None, 1, 1, 2]), START.date() + timedelta(days=rng.randrange(2)), rng.randrange(40), i) for i in range(120)]
    want = Counter()
    for day in {r[2] for r in rows}:
        order = sorted((r for r in rows if r[2] == day), key=lambda r: (r[3], r[4]))
        for at in range(0, len(order), window):
            for (t, c, *_), (u, d, *_) in combinations(order[at : at + window], 2):
                want[min(t, u), max(t, u), c is not None and c == d] += 1
    df = spark.createDataFrame(rows, "token_id long, client_id long, trade_date date, ts_us long, event_id long")
    assert {(r["token_a"], r["token_b"], r["same_client"]): r["n"] for r in window_pair_counts(df, window=window).collect()} == want


def lines(spark, rows):
    return spark.createDataFrame(rows, "g long, us long, item long, n int")


@pytest.mark.parametrize("stretch", [3, 50, 16_384])
def test_greedy_sequences_against_brute_force(spark, stretch):
    rng = random.Random(stretch)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(10**12), i, rng.choice([3, 7, 7, 40])) for i in range(400)] + [(None, 1, 900, 3), (1, None, 901, 3), (1, 5, 902, None)]
    want = {}
    for g in (1, 2, 3):
        fill = number = 0
        for _, _, item, n in sorted((r for r in rows if r[0] == g and None not in r), key=lambda r: (r[1], r[2])):
            if fill + n > 30 and fill:
                fill, number = 0, number + 1
            fill += n
            want[item] = (g, number)
    got = {r["item"]: (r["grp"], r["seq_no"]) for r in greedy_sequences(lines(spark, rows), "g", "us", "item", F.col("n"), 30, stretch=stretch).collect()}
    assert got == want
    assert greedy_sequences(lines(spark, []), "g", "us", "item", F.col("n"), 30).count() == 0


@pytest.mark.parametrize("stretch", [64, 32_768])
def test_tape_windows_against_brute_force(spark, stretch):
    rng = random.Random(stretch)
    rows = [(rng.choice([1, 1, 2]), rng.randrange(10**10), i, rng.choice([3, 7])) for i in range(700)]
    want = set()
    for g in (1, 2):
        sizes = [r[3] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))]
        cum = [0]
        for n in sizes:
            cum.append(cum[-1] + n)
        at = number = 0
        while at < len(sizes):
            end = max(max(i for i, c in enumerate(cum) if c <= cum[at] + 60), at + 1)
            want.add((g, number, at, end - at, cum[end] - cum[at]))
            number, at = number + 1, max(max(i for i, c in enumerate(cum) if c <= cum[at] + 30), at + 1)
    got = {tuple(r) for r in tape_windows(lines(spark, rows), F.col("g"), "us", "item", F.col("n"), 60, 30, stretch=stretch).collect()}
    assert got == want
    assert tape_windows(lines(spark, []), F.col("g"), "us", "item", F.col("n"), 60, 30).count() == 0


def test_contexts_anchors_and_mixture(spark):
    df = spark.createDataFrame([([1, 2, 3], [0, 3, 3]), ([5], [3]), (None, None)], "t array<int>, f array<int>")
    i, l = fixed_context(F.col("t"), 2)
    assert [tuple(r) for r in df.select(i, l, anchor_positions(F.col("f"))).collect()] == [([1, 2], [1, 2], [0, 1]), ([5, 0], [5, -100], []), (None, None, None)]
    seqs = spark.createDataFrame([(k, k >= 60) for k in range(80)] + [(None, True)], "s long, t boolean")
    plan = mixture_plan(seqs, "s", F.col("t"), 0.25, (1, 2)).collect()
    assert sorted(r["position"] for r in plan) == list(range(80)) and 8 <= sum(r["is_tape"] for r in plan) <= 35
    assert all(r["is_tape"] == (r["seq_id"] >= 60) for r in plan)
    assert mixture_plan(seqs.where("t"), "s", F.col("t"), 0.25, (1, 2)).count() == 0


def test_buckets(spark):
    values = spark.createDataFrame([(0.5,), (1.0,), (60.0,), (3600.0,), (2.592e6,), (1e9,), (0.0,), (-1.0,), (None,)], "s double")
    assert [r[0] for r in values.select(gap_bucket(F.col("s"))).collect()] == [1, 1, 7, 14, 24, 24, 0, 0, 0]
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (6,), (10,), (None,)], "n int").select(edge_bucket(F.col("n"), DEALER_EDGES)).collect()] == [0, 1, 5, 7, None]


def test_dictionary(spark):
    codes = D.sorted_codes(spark.createDataFrame([(9,), (5,), (9,), (None,), (70_000,)], "id long"), "id", 31)
    assert {r["raw_id"]: r["gid"] for r in codes.collect()} == {5: 31, 9: 32, 70_000: 33}
    coded = D.encode(spark.createDataFrame([(9, 1), (6, 2), (None, 3)], "id long, raw_id int"), "id", codes, "g")
    assert {r["raw_id"]: r["g"] for r in coded.collect()} == {1: 32, 2: D.UNK, 3: D.UNK}
    r = D.Ranges(2400, 3600)
    assert [r.first(f) for f in ("TDLT", "CLI", "TOK", "SZ", "NDLR", "OUT")] == [6, 31, 2431, 6031, 6039, 6047]


def test_tokens_that_must_be_known(spark):
    known = spark.createDataFrame([(5, 0, 50), (5, 1, 51), (5, 2, 52), (6, 0, 60)], "instrument_id long, sense int, token_id long")
    lines = lambda *rows: spark.createDataFrame([(*r, "x") for r in rows], "instrument_id long, client_side_disclosed int, sense string")
    assert [r["observed_token"] for r in D.tokens_for(lines((5, 2), (6, 0)), known).collect()] == [52, 60]
    for row, message in (((5, 3), "no such sense: 3"), ((5, None), "no such sense: null"), ((6, 1), "no token for instrument 6"), ((None, 0), "no token for instrument null")):
        with pytest.raises(Exception, match=message):
            D.tokens_for(lines(row), known).collect()
    assert {r["token_id"]: (r["instrument_row"], r["sense"]) for r in D.token_rows(known).collect()} == {50: (0, 0), 51: (0, 1), 52: (0, 2), 60: (1, 0)}


def test_registration_and_retirement(spark):
    at = lambda d: START + timedelta(days=d)
    kinds = "token_id long, instrument_id long, sense tinyint, born_ts timestamp, retired_ts timestamp"
    known = spark.createDataFrame([(i, 5, i, at(0), None) for i in range(3)], kinds)
    more = spark.createDataFrame([(9, at(3)), (8, at(3)), (2, at(9)), (None, at(1)), (4, None)], "instrument_id long, born_ts timestamp")
    grown = D.register(known, more)
    got = {r["token_id"]: (r["instrument_id"], r["sense"]) for r in grown.collect()}
    assert got == {i * 3 + s: (k, s) for i, k in enumerate((5, 8, 9, 2)) for s in range(3)} and grown.dtypes == known.dtypes
    for twice in ([(5, at(1))], [(7, at(1)), (7, at(2))]):
        with pytest.raises(Exception, match="already registered"):
            D.register(known, spark.createDataFrame(twice, "instrument_id long, born_ts timestamp")).collect()
    gone = D.retire(grown, spark.createDataFrame([(8, at(5)), (8, at(4)), (77, at(1))], "instrument_id long, retired_ts timestamp"))
    alive = lambda d: {r["token_id"] for r in D.valid_at(gone, "born_ts", "retired_ts", F.lit(at(d))).collect()}
    assert alive(1) == {0, 1, 2} and alive(3) == set(range(9)) and alive(4) == {0, 1, 2, 6, 7, 8} and alive(10) == {0, 1, 2, *range(6, 12)}


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(90), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "a long, b long, n long").repartition(4)
    got = {r["b"]: r["before"] for r in running_total(df, ["a", "b"], F.floor(F.col("a") / 7), "n", "before").collect()}
    total = 0
    for _, b, n in sorted(rows):
        assert got[b] == total
        total += n


def test_decoding_undoes_encoding(spark):
    clients, tokens = spark.createDataFrame([(8,), (3,)], "client_id long"), spark.createDataFrame([(70,), (10,), (40,)], "token_id long")
    known = D.vocabulary(spark, clients, tokens)
    codes = D.sorted_codes(tokens, "token_id", D.ranges(clients, tokens).first("TOK"))
    coded = D.encode(spark.createDataFrame([(40, 1), (11, 2), (None, 3)], "t long, family int"), "t", codes, "g")
    assert {r["t"]: (r["family"], r["raw_id"]) for r in D.decode(coded, "g", known).collect()} == {40: ("TOK", 40), 11: ("SPECIAL", D.UNK), None: ("SPECIAL", D.UNK)}
    assert D.decode(spark.createDataFrame([(10**6,)], "g long"), "g", known).first()["family"] is None


def test_ranks_and_previous_times(spark):
    rng = random.Random(1)
    rows = [(rng.choice([1, 1, 2, None]), rng.randrange(50), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, us long, item long")
    ranked = rank_in_group(df, ["g"], ["us", "item"], F.floor(F.col("us") / 7), salts=1).collect()
    assert {r["rank"] for r in ranked if r["g"] is None} == {None}
    for g in (1, 2):
        order = sorted((r["us"], r["item"]) for r in ranked if r["g"] == g)
        assert [order.index((r["us"], r["item"])) for r in ranked if r["g"] == g] == [r["rank"] for r in ranked if r["g"] == g]
    salted = rank_in_group(df, ["g"], ["item"]).collect()
    assert sorted(r["rank"] for r in salted if r["g"] == 1) == list(range(sum(g == 1 for g, *_ in rows)))
    before = {r["item"]: r["previous_us"] for r in previous_time(df, "g", "us", "item", chunk_us=7).collect()}
    assert len(before) == 300
    for g in (1, 2):
        order = sorted((u, i) for k, u, i in rows if k == g)
        assert [before[i] for _, i in order] == [None, *(u for u, _ in order[:-1])]


def test_states_are_chained_over_levels(spark):
    rng = random.Random(12)
    rows = [(g, s, [rng.randrange(4) for _ in range(4)], [rng.randrange(3) for _ in range(4)]) for g, n in ((1, 40), (2, 3), (5, 1)) for s in range(n)]
    want = {}
    for g in (1, 2, 5):
        state = number = 0
        for _, s, after, marks in sorted(r for r in rows if r[0] == g):
            want[g, s] = (state, number)
            state, number = after[state], number + marks[state]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "grp long, stretch long, after array<int>, marks array<int>")
    for fan in (2, 3, 256):
        assert {(r["grp"], r["stretch"]): (r["state"], r["number"]) for r in begins(df, fan).collect()} == want
    assert begins(df.where("false")).count() == 0


def test_greedy_sequences_over_many_batches(spark):
    rng = random.Random(21)
    rows = [(rng.choice([1, 1, 2, 3, 3, 4]), rng.randrange(10**12), i, rng.choice([3, 7, 45])) for i in range(300)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        got = {r["item"]: r["seq_no"] for r in greedy_sequences(lines(spark, rows), "g", "us", "item", F.col("n"), 30, stretch=40).collect()}
    finally:
        spark.conf.set(size, before)
    for g in range(1, 5):
        fill = number = 0
        for _, _, item, n in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            if fill + n > 30 and fill:
                fill, number = 0, number + 1
            fill += n
            assert got[item] == number
