"""Registered queries over the tape: disclosure, encoding, packages, sequences, grids."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.epoch import micros
from tickloom.operators import blocks as B
from tickloom.operators import dictionary as D
from tickloom.operators import disclosure as P
from tickloom.operators import grid as G
from tickloom.operators import summary as S
from tickloom.operators.packages import latest_lines, packages_by_first_lines, sentences, window_pair_counts
from tickloom.operators.sequences import anchor_positions, fixed_context, greedy_sequences, mixture_plan, packed
from tickloom.operators.tape_windows import tape_windows
from tickloom.plans.ranking import running_total
from tickloom.plans.storage import materialise
from tickloom.queries_vectors import SQL as VECTOR_SQL
from tickloom.queries_vectors import _U, _philox_sql, norm_frequency
from tickloom.sources.tables import table

CONTEXT = 256
POLICIES = {
    "default": P.DEFAULT,
    "strict": P.STRICT,
    "all_quoters": P.Policy(cover_shown_to=frozenset({P.WON, P.COVER, P.LOST})),
    "public_prints": P.Policy(prints=True),
    "late": P.Policy(sides_of_trades=frozenset({P.WON, P.COVER, P.LOST}), sides_of_others=frozenset({P.EXPIRED}), lag_us=5_000_000),
}


def _tape(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "rfq_lines")


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return latest_lines(_tape(spark, root)).withColumn("ts_us", micros(F.col("ts")))


def _written_lines(spark: SparkSession, root: str) -> DataFrame:
    """The columns that blocks and sequences take of the lines, written once for both."""
    own = ["event_id", "client_id", "ts_us", "line_no", "token_id", "qty_par", "n_dealers", "enquiry_outcome", "our_result"]
    return materialise(_lines(spark, root).select(*own), "lines")


def _flat(view: DataFrame) -> DataFrame:
    long = {c: F.col(c).cast("long").alias(c) for c in ("event_id", "client_id", "enquiry_outcome", "our_result", "side_revealed")}
    prices = [F.col(c).cast("double").alias(c) for c in ("exec_sprd_bp", "exec_px", "cover_sprd_bp", "cover_px")]
    return view.select(*long.values(), micros(F.col("side_reveal_ts")).alias("side_reveal_us"), *prices)


def _observable(name: str):
    def run(spark: SparkSession, root: str) -> DataFrame:
        return _flat(P.observable(_tape(spark, root), POLICIES[name]))

    run.__name__ = f"observable_{name}"
    run.__doc__ = f"The observable tape under the {name} policy."
    return run


def leakage_audit(spark: SparkSession, root: str) -> DataFrame:
    """Breaches of the strict policy in a view made under the widest one, per rule."""
    return P.audit(P.observable(_tape(spark, root), POLICIES["late"]), P.STRICT)


def leakage_audit_clean(spark: SparkSession, root: str) -> DataFrame:
    """Breaches of a policy in its own view: none."""
    return P.audit(P.observable(_tape(spark, root), POLICIES["late"]), POLICIES["late"])


def invariant_report(spark: SparkSession, root: str) -> DataFrame:
    return P.invariants(_tape(spark, root))


def observable_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Token of each received line from its instrument and disclosed side."""
    out = D.observable_tokens(_tape(spark, root).where("received").select("event_id", "instrument_id", "client_side_disclosed"), table(spark, root, "token_map"))
    return out.select("event_id", "observed_token")


def strict_tokens(spark: SparkSession, root: str) -> DataFrame:
    """The same, where a side that is no sense or an unknown instrument would fail the query."""
    out = D.tokens_for(_tape(spark, root).where("received").select("event_id", "instrument_id", "client_side_disclosed"), table(spark, root, "token_map"))
    return out.select("event_id", "observed_token")


def token_rows(spark: SparkSession, root: str) -> DataFrame:
    """Each token's instrument as a row number, and its sense."""
    return D.token_rows(table(spark, root, "token_map"))


def token_parity(spark: SparkSession, root: str) -> DataFrame:
    """Per day: received lines, and those whose observed token is the logged one."""
    out = D.observable_tokens(_tape(spark, root).where("received").select("trade_date", "token_id", "instrument_id", "client_side_disclosed"), table(spark, root, "token_map"))
    return out.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_lines"), F.count(F.when(F.col("observed_token") == F.col("token_id"), 1)).alias("n_equal"))


def vocabulary(spark: SparkSession, root: str) -> DataFrame:
    return D.vocabulary(spark, table(spark, root, "clients"), table(spark, root, "token_map"))


def vocabulary_layout(spark: SparkSession, root: str) -> DataFrame:
    """Instruments whose tokens are not laid out as registered: none."""
    return D.layout_breaks(table(spark, root, "token_map"))


def vocabulary_saved(spark: SparkSession, root: str) -> DataFrame:
    """The vocabulary as written to the shared folder and read again."""
    return materialise(vocabulary(spark, root), "vocabulary")


def decoded_blocks(spark: SparkSession, root: str) -> DataFrame:
    """How often each id of each family stands in the lines' blocks, by decoding the blocks' tokens."""
    tokens = B.blocks(_lines(spark, root), *_codes(spark, root)).select(F.explode("tokens").alias("gid")).groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    return D.decode(tokens, "gid", vocabulary(spark, root)).select("family", "raw_id", "n")


def anchor_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Per axis of the written sequences: events at anchors, those of them on the tape, and the tape's events without an anchor."""
    known = _tape(spark, root).select("event_id").distinct()
    anchors = table(spark, root, "packed_corpus").select("axis", F.explode("event_id").alias("event_id")).where("event_id <> 0").distinct()
    met = anchors.join(known.withColumn("on_tape", F.lit(1)), "event_id", "left").groupBy("axis").agg(F.count(F.lit(1)).alias("n_anchored"), F.count("on_tape").alias("n_on_tape"))
    return met.select("axis", "n_anchored", "n_on_tape", (known.agg(F.count(F.lit(1))).scalar() - F.col("n_on_tape")).alias("n_missing"))


def token_lifecycle(spark: SparkSession, root: str) -> DataFrame:
    """A token map built anew: every instrument registered in the order of its birth, and retired as the given map has it."""
    known = table(spark, root, "token_map")
    by = known.groupBy("instrument_id").agg(F.min("born_ts").alias("born_ts"), F.max("retired_ts").alias("retired_ts"))
    built = D.retire(D.register(known.where("false"), by.select("instrument_id", "born_ts")), by.select("instrument_id", "retired_ts").where("retired_ts IS NOT NULL"))
    return built.select("token_id", "instrument_id", F.col("sense").cast("long").alias("sense"), micros(F.col("born_ts")).alias("born_us"), micros(F.col("retired_ts")).alias("retired_us"))


def tokens_alive(spark: SparkSession, root: str) -> DataFrame:
    """Per sense, tokens in force at the middle of the tape."""
    alive = D.valid_at(table(spark, root, "token_map"), "born_ts", "retired_ts", F.lit("2010-02-01 00:00:00+00:00").cast("timestamp"))
    return alive.groupBy(F.col("sense").cast("long").alias("sense")).agg(F.count(F.lit(1)).alias("n"))


def _codes(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, D.Ranges]:
    clients, tokens = table(spark, root, "clients"), table(spark, root, "token_map")
    r = D.ranges(clients, tokens)
    return D.sorted_codes(clients, "client_id", r.first("CLI")), D.sorted_codes(tokens, "token_id", r.first("TOK")), r


def vocabulary_encode(spark: SparkSession, root: str) -> DataFrame:
    """Lines' clients as ids, where clients that joined in 2009 or later are unknown."""
    clients = table(spark, root, "clients")
    r = D.ranges(clients, table(spark, root, "token_map"))
    codes = D.sorted_codes(clients.where("onboard_date < DATE'2009-01-01'"), "client_id", r.first("CLI"))
    out = D.encode(_tape(spark, root).select("client_id"), "client_id", codes, "gid")
    return out.groupBy("gid").agg(F.count(F.lit(1)).alias("n"))


def gap_buckets(spark: SparkSession, root: str) -> DataFrame:
    """First legs per bucket of the gap to their client's previous one."""
    first = B.with_gaps(_lines(spark, root).select("event_id", "client_id", "ts_us", "line_no"))
    return first.groupBy(B.gap_bucket(F.col("gap_s")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def size_dealer_buckets(spark: SparkSession, root: str) -> DataFrame:
    lines = _lines(spark, root)
    return lines.groupBy(B.edge_bucket(F.col("qty_par"), B.SIZE_EDGES).alias("size_bucket"), B.edge_bucket(F.col("n_dealers"), B.DEALER_EDGES).alias("dealer_bucket")).agg(F.count(F.lit(1)).alias("n"))


def token_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Every line's block, a token per row."""
    out = B.blocks(_lines(spark, root), *_codes(spark, root))
    return out.select("event_id", F.posexplode(F.arrays_zip("tokens", "families")).alias("pos", "x")).select("event_id", F.col("pos").cast("long").alias("pos"), F.col("x.tokens").alias("token"), F.col("x.families").cast("long").alias("family"))


def package_sentences(spark: SparkSession, root: str) -> DataFrame:
    out = sentences(_lines(spark, root))
    return out.select("package_id", "client_id", "trade_date", "ts_first_us", F.array_join("tokens", " ").alias("tokens"))


def multi_author_packages(spark: SparkSession, root: str) -> DataFrame:
    """Packages with more than one client, here taken by instrument to have some."""
    out = _lines(spark, root).groupBy("instrument_id").agg(F.count_distinct("client_id").alias("n_clients"), F.count(F.lit(1)).alias("n_lines"))
    return out.where("n_clients > 1")


def line_packages(spark: SparkSession, root: str) -> DataFrame:
    """Each line's package, from the ids and line numbers alone."""
    out = packages_by_first_lines(_lines(spark, root))
    return out.select(F.col("item").alias("event_id"), F.col("package").alias("package_id"))


def pair_counts(spark: SparkSession, root: str) -> DataFrame:
    """Token pairs within stretches of 64 lines of a day, by whether one client sent both."""
    return window_pair_counts(_lines(spark, root))


def _session_items(lines: DataFrame) -> DataFrame:
    length = F.when(F.col("line_no") == 0, 7).otherwise(3)
    return greedy_sequences(lines, "client_id", "ts_us", "event_id", length, CONTEXT - 2)


def session_windows(spark: SparkSession, root: str) -> DataFrame:
    """Each client's lines in runs that fit a context."""
    return _session_items(_lines(spark, root)).select(F.col("grp").alias("client_id"), F.col("item").alias("event_id"), "seq_no")


def packed_sessions(spark: SparkSession, root: str) -> DataFrame:
    """The runs' tokens between begin and end marks."""
    lines = _written_lines(spark, root)
    out = packed(_session_items(lines), B.blocks(lines, *_codes(spark, root)))
    return out.select(F.col("grp").alias("client_id"), "seq_no", "n_lines", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def tape_stretches(spark: SparkSession, root: str) -> DataFrame:
    """Windows of a context along each month's lines of all clients, each half a context on from the last."""
    month = F.year("trade_date") * 12 + F.month("trade_date") - 1
    out = tape_windows(_lines(spark, root), month, "ts_us", "event_id", F.when(F.col("line_no") == 0, 7).otherwise(3), CONTEXT - 2, (CONTEXT - 2) // 2)
    return out.withColumnRenamed("grp", "month_no")


def _corpus(items: DataFrame, lines: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    out = packed(items, B.blocks(lines, *_codes(spark, root)))
    return out.select("grp", "seq_no", "n_lines", *(F.array_join(c, " ").alias(c) for c in ("tokens", "family", "event_ids")))


def session_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Each client's lines in runs that fit a context: tokens, their families, and the lines' ids at their anchors."""
    lines = _written_lines(spark, root)
    return _corpus(_session_items(lines), lines, spark, root).withColumnRenamed("grp", "client_id")


def tape_corpus(spark: SparkSession, root: str) -> DataFrame:
    """The same of windows along the whole tape of all clients, one chain over all months, each half a context on from the last."""
    lines = _written_lines(spark, root)
    length = F.when(F.col("line_no") == 0, 7).otherwise(3)
    items = tape_windows(lines, F.lit(0), "ts_us", "event_id", length, CONTEXT - 2, (CONTEXT - 2) // 2, members=True)
    return _corpus(items, lines, spark, root).drop("grp")


def sequence_offsets(spark: SparkSession, root: str) -> DataFrame:
    """Where each client's runs stand in the stream of all of them, one after another with their two marks."""
    length = F.when(F.col("line_no") == 0, 7).otherwise(3)
    lines = _written_lines(spark, root)
    items = _session_items(lines).join(lines.select(F.col("event_id").alias("item"), length.alias("length")), "item")
    runs = items.groupBy(F.col("grp").alias("client_id"), "seq_no").agg((F.sum("length") + 2).alias("n_tokens"))
    out = running_total(runs, ["client_id", "seq_no"], F.floor(F.col("client_id") / 64), "n_tokens", "seq_start")
    return out.select("client_id", "seq_no", "seq_start", (F.col("seq_start") + F.col("n_tokens")).alias("seq_end"))


def training_mixture(spark: SparkSession, root: str) -> DataFrame:
    """Written sequences in a training order, a quarter of it tape."""
    return mixture_plan(table(spark, root, "packed_corpus").where("tokens IS NOT NULL"), "seq_id", F.col("axis") == "tape", 0.25, (11, 13))


def fixed_contexts(spark: SparkSession, root: str) -> DataFrame:
    """Written sequences cut or padded to a context: tokens kept, padding, sum of the labels."""
    inputs, labels = fixed_context(F.col("tokens"), CONTEXT)
    rows = table(spark, root, "packed_corpus").where("tokens IS NOT NULL").select("seq_id", F.size("tokens").alias("n"), inputs.alias("i"), labels.alias("l"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("seq_id", F.size("i").cast("long").alias("n_inputs"), F.least("n", F.lit(CONTEXT)).cast("long").alias("n_kept"), add("i").alias("input_sum"), add("l").alias("label_sum"))


def all_contexts(spark: SparkSession, root: str) -> DataFrame:
    """Written sequences in as many contexts as they fill, so that no token is dropped; the last one is padded."""
    last = F.greatest(F.floor((F.size("tokens") - 1) / CONTEXT).cast("int"), F.lit(0))
    parts = table(spark, root, "packed_corpus").where("tokens IS NOT NULL").select("seq_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    parts = parts.select("seq_id", "k", F.slice("tokens", F.col("k") * CONTEXT + 1, F.lit(CONTEXT)).alias("t"))
    inputs, labels = fixed_context(F.col("t"), CONTEXT)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    return parts.select("seq_id", F.col("k").cast("long").alias("context_no"), F.size("t").cast("long").alias("n_kept"), add(inputs).alias("input_sum"), add(labels).alias("label_sum"))


def anchor_predictions(spark: SparkSession, root: str) -> DataFrame:
    """Per written sequence: positions at which the next token is an anchor."""
    rows = table(spark, root, "packed_corpus").where("size(family) > 1").select("seq_id", anchor_positions(F.col("family")).alias("p"))
    return rows.select("seq_id", F.size("p").cast("long").alias("n_anchors"), F.array_min("p").cast("long").alias("first_pos"), F.array_max("p").cast("long").alias("last_pos"))


def _grid(spark: SparkSession, root: str, slot_us: int) -> DataFrame:
    return G.grid_counts(_lines(spark, root), "trade_date", F.floor(F.pmod(F.col("ts_us"), F.lit(86_400_000_000)) / slot_us), 0, 86_400_000_000 // slot_us - 1)


def hour_grid(spark: SparkSession, root: str) -> DataFrame:
    """Lines per hour of day, empty hours included: every line is in one hour."""
    return _grid(spark, root, 3_600_000_000)


def minute_grid(spark: SparkSession, root: str) -> DataFrame:
    """Lines per minute of day, empty minutes included: every line is in one minute."""
    return _grid(spark, root, 60_000_000)


def trading_clock(spark: SparkSession, root: str) -> DataFrame:
    """Lines on a clock that runs only in sessions from 9 to 17 on weekdays of the tape."""
    lines = _lines(spark, root)
    days = lines.select("trade_date").distinct().where("weekday(trade_date) < 5")
    midnight = F.datediff("trade_date", F.lit("1970-01-01")).cast("long") * 86_400_000_000
    calendar = days.select("trade_date", (midnight + 9 * 3_600_000_000).alias("open_us"), (midnight + 17 * 3_600_000_000).alias("close_us"))
    return G.session_clock(lines.select("event_id", "ts_us"), calendar).select("event_id", "session_us")


def side_sojourns(spark: SparkSession, root: str) -> DataFrame:
    """Runs of one disclosed side of each client and day."""
    lines = _lines(spark, root).where("client_id IS NOT NULL").withColumn("side", F.col("client_side_disclosed").cast("long"))
    return G.sojourns(lines, ["client_id", "trade_date"], ["ts_us", "event_id"], "ts_us", "side")


def _drift(spark: SparkSession, root: str) -> DataFrame:
    lines = _lines(spark, root)
    hour = F.floor(F.pmod(F.col("ts_us"), F.lit(86_400_000_000)) / 3_600_000_000)
    sides = F.array(*(F.count(F.when(F.col("client_side_disclosed") == s, 1)).cast("double") for s in range(3)))
    grid = lines.groupBy("trade_date", hour.alias("hour")).agg(sides.alias("c"))
    return G.rolling_drift(G.steps(grid, "trade_date", "hour", "c"), "trade_date", "hour", 4)


def hourly_drift(spark: SparkSession, root: str) -> DataFrame:
    """Movement of the hourly side counts over any four hours of a day."""
    return _drift(spark, root)


def hourly_drift_summary(spark: SparkSession, root: str) -> DataFrame:
    out = G.drift_summary(_drift(spark, root))
    return out.select(F.round("mean", 6).alias("mean"), F.round("p99", 6).alias("p99"), "greatest", "n")


def drift_budget(spark: SparkSession, root: str) -> DataFrame:
    """Per token vector's norm: expected movement in 30 steps, and the steps within a budget."""
    from tickloom.functions.vectors import norm

    rows = table(spark, root, "embeddings").select("vec_id", norm(F.col("embedding")).alias("r0"))
    rho = F.lit(0.999)
    l2, l1 = G.displacement(F.col("r0"), rho, F.lit(30.0), 64)
    return rows.select("vec_id", F.round(l2, 6).alias("l2"), F.round(l1, 6).alias("l1"), G.longest_window(F.col("r0"), rho, F.lit(0.5)).alias("max_steps"))


def activity_level(spark: SparkSession, root: str) -> DataFrame:
    """A client's activity that halves each day."""
    out = G.decayed_level(_lines(spark, root), "client_id", F.col("trade_date"), F.lit(1), 0.5)
    return out.select("client_id", "day", F.round("level", 6).alias("level"))


def validation_battery(spark: SparkSession, root: str) -> DataFrame:
    """Shares of the tape within their bands."""
    every = F.lit(True)
    traded = F.col("enquiry_outcome") == P.TRADED
    checks = {
        "hit_rate": ((F.col("our_result") == P.WON) & traded, F.col("received"), 0.03, 0.10),
        "traded": (traded, every, 0.45, 0.90),
        "two_way": (F.col("client_side_disclosed") == P.TWO_WAY, every, 0.08, 0.45),
        "received": (F.col("received"), every, 0.35, 0.90),
    }
    return S.shares(_lines(spark, root), checks).select("check", F.round("value", 9).alias("value"), "low", "high", "status")


def validation_shape(spark: SparkSession, root: str) -> DataFrame:
    """Skew of the tokens, and how their frequency goes with their vectors' size, against their bands."""
    gini = token_gini(spark, root).select(F.lit("token_gini").alias("check"), F.col("gini").alias("value"), F.lit(0.35).alias("low"), F.lit(0.95).alias("high"))
    norms = norm_frequency(spark, root).select(F.lit("norm_frequency").alias("check"), F.col("correlation").alias("value"), F.lit(0.3).alias("low"), F.lit(None).cast("double").alias("high"))
    value, inside = F.col("value"), (F.col("value") >= F.col("low")) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
    return gini.unionByName(norms).select("check", value, "low", "high", F.when(inside, "PASS").otherwise("FAIL").alias("status"))


def token_counts(spark: SparkSession, root: str) -> DataFrame:
    """Lines of every token of the dictionary, zero included."""
    return S.dense_counts(table(spark, root, "token_map"), "token_id", _lines(spark, root), "token_id")


def token_gini(spark: SparkSession, root: str) -> DataFrame:
    out = S.gini(token_counts(spark, root))
    return out.select("n_active", F.round("gini", 9).alias("gini"))


_T = "client_side_disclosed <> 2"
_LINES = "lines AS (SELECT *, epoch_us(ts) AS ts_us FROM rfq_lines QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY outcome_ts DESC, enquiry_outcome, our_result, client_id NULLS LAST) = 1)"


def _view_sql(side: str, execution: str, cover: str, lag: int) -> str:
    return f"""
SELECT event_id, client_id, CAST(enquiry_outcome AS BIGINT) AS enquiry_outcome, CAST(our_result AS BIGINT) AS our_result,
    CAST(CASE WHEN {_T} THEN client_side_disclosed WHEN {side} THEN client_side_true END AS BIGINT) AS side_revealed,
    CASE WHEN {_T} THEN epoch_us(ts) WHEN {side} THEN epoch_us(outcome_ts) + {lag} END AS side_reveal_us,
    CAST(CASE WHEN {execution} THEN exec_sprd_bp END AS DOUBLE) AS exec_sprd_bp, CASE WHEN {execution} THEN exec_px END AS exec_px,
    CAST(CASE WHEN {cover} THEN cover_sprd_bp END AS DOUBLE) AS cover_sprd_bp, CASE WHEN {cover} THEN cover_px END AS cover_px
FROM rfq_lines WHERE received"""


_TRADED_WON = "enquiry_outcome = 0 AND our_result = 0"
_LATE = "((enquiry_outcome = 0 AND our_result IN (0, 1, 2)) OR enquiry_outcome = 3)"
_SIDES = "(enquiry_outcome = 0 AND our_result IN (0, 1))"
_RULES = ("disclosed_side_changed", "disclosed_time_changed", "two_way_side_shown", "reveal_before_request", "reveal_without_time", "execution_shown", "cover_shown")
_CLIENT_CODES = "cli AS (SELECT client_id, 30 + row_number() OVER (ORDER BY client_id) AS gid FROM (SELECT DISTINCT client_id FROM clients))"
_TOKEN_CODES = "tok AS (SELECT token_id, 30 + (SELECT count(*) FROM cli) + row_number() OVER (ORDER BY token_id) AS gid FROM (SELECT DISTINCT token_id FROM token_map))"
_VOCABULARY = """
SELECT 'SPECIAL' AS family, range AS raw_id, range AS gid FROM range(6) UNION ALL SELECT 'TDLT', range, 6 + range FROM range(25)
UNION ALL SELECT 'CLI', client_id, gid FROM cli UNION ALL SELECT 'TOK', token_id, gid FROM tok
UNION ALL SELECT f, range, (SELECT count(*) FROM cli) + (SELECT count(*) FROM tok) + 31 + o + range FROM (VALUES ('SZ', 0, 8), ('NDLR', 8, 8), ('OUT', 16, 24)) t(f, o, s), range(24) WHERE range < s"""
_SIZE = " + ".join(f"CAST(qty_par >= {e:.0f} AS BIGINT)" for e in B.SIZE_EDGES)
_DEALERS = " + ".join(f"CAST(n_dealers >= {e} AS BIGINT)" for e in B.DEALER_EDGES)
_GAPS = "gaps AS (SELECT event_id, client_id, (ts_us - lag(ts_us) OVER (PARTITION BY client_id ORDER BY ts_us, event_id)) / 1e6 AS g FROM lines WHERE line_no = 0)"
_GAP_BUCKET = "CAST(CASE WHEN client_id IS NOT NULL AND g > 0 THEN least(floor(ln(least(greatest(g, 1.0), 2592000.0)) / ln(2592000.0) * (24 - 1e-9)) + 1, 24) ELSE 0 END AS BIGINT)"
_BLOCKS = f"""{_LINES}, {_CLIENT_CODES}, {_TOKEN_CODES}, {_GAPS},
base AS (
    SELECT l.*, coalesce(c.gid, 5) AS c_gid, coalesce(t.gid, 5) AS t_gid, {_GAP_BUCKET.replace("client_id", "l.client_id")} AS gap, {_SIZE} AS sz, {_DEALERS} AS nd,
        least(greatest(enquiry_outcome, 0), 3) * 6 + least(greatest(our_result, 0), 5) AS oc, (SELECT count(*) FROM cli) + (SELECT count(*) FROM tok) + 31 AS tail
    FROM lines l LEFT JOIN cli c USING (client_id) LEFT JOIN tok t USING (token_id) LEFT JOIN gaps g ON g.event_id = l.event_id
),
blk AS (
    SELECT event_id, client_id, ts_us, line_no, CASE WHEN line_no = 0 THEN [CAST(3 AS BIGINT), 6 + gap, c_gid, t_gid, tail + sz, tail + 8 + nd, CAST(tail + 16 + oc AS BIGINT)] ELSE [CAST(4 AS BIGINT), t_gid, tail + sz] END AS toks,
        CASE WHEN line_no = 0 THEN [0, 1, 2, 3, 4, 5, 6] ELSE [0, 3, 4] END AS fams FROM base
)"""
_WINDOWS = f"""{_LINES},
sized AS (SELECT client_id, event_id, CASE WHEN line_no = 0 THEN 7 ELSE 3 END AS len, row_number() OVER (PARTITION BY client_id ORDER BY ts_us, event_id) AS rn FROM lines WHERE client_id IS NOT NULL),
cut AS (
    SELECT client_id, event_id, rn, len AS fill, CAST(0 AS BIGINT) AS seq_no FROM sized WHERE rn = 1
    UNION ALL
    SELECT s.client_id, s.event_id, s.rn, CASE WHEN c.fill + s.len > 254 THEN s.len ELSE c.fill + s.len END, CASE WHEN c.fill + s.len > 254 THEN c.seq_no + 1 ELSE c.seq_no END
    FROM cut c JOIN sized s ON s.client_id = c.client_id AND s.rn = c.rn + 1
)"""
_JOINED = "'1 ' || string_agg(array_to_string(toks, ' '), ' ' ORDER BY {order}) || ' 2' AS tokens, '0 ' || string_agg(array_to_string(fams, ' '), ' ' ORDER BY {order}) || ' 0' AS family, '0 ' || string_agg(array_to_string(list_transform(fams, lambda f: CASE WHEN f = 3 THEN b.event_id ELSE 0 END), ' '), ' ' ORDER BY {order}) || ' 0' AS event_ids"
_DRIFT = f"""{_LINES},
grid AS (SELECT trade_date, CAST((ts_us % 86400000000) // 3600000000 AS BIGINT) AS hour, count(*) FILTER (client_side_disclosed = 0) AS a, count(*) FILTER (client_side_disclosed = 1) AS b, count(*) FILTER (client_side_disclosed = 2) AS c FROM lines GROUP BY ALL),
stepped AS (SELECT trade_date, hour, CAST(abs(a - lag(a) OVER w) + abs(b - lag(b) OVER w) + abs(c - lag(c) OVER w) AS DOUBLE) AS step FROM grid WINDOW w AS (PARTITION BY trade_date ORDER BY hour)),
rolled AS (SELECT trade_date, hour, sum(step) OVER w AS drift, count(*) OVER w AS k FROM stepped WHERE step IS NOT NULL WINDOW w AS (PARTITION BY trade_date ORDER BY hour ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
drift AS (SELECT trade_date, hour, drift FROM rolled WHERE k = 4)"""
_CHECKS = {
    "hit_rate": ("our_result = 0 AND enquiry_outcome = 0", "received", 0.03, 0.10),
    "traded": ("enquiry_outcome = 0", "true", 0.45, 0.90),
    "two_way": ("client_side_disclosed = 2", "true", 0.08, 0.45),
    "received": ("received", "true", 0.35, 0.90),
}



def _grid_sql(slot_us: int) -> str:
    return f"""
WITH {_LINES}, counts AS (SELECT trade_date AS day, CAST((ts_us % 86400000000) // {slot_us} AS BIGINT) AS slot, count(*) AS n FROM lines GROUP BY ALL)
SELECT d.day, s.range AS slot, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT day FROM counts) d CROSS JOIN range(0, {86_400_000_000 // slot_us}) s LEFT JOIN counts c ON c.day = d.day AND c.slot = s.range"""


SQL = {
    "observable_default": _view_sql(_SIDES, _TRADED_WON, _TRADED_WON, 0),
    "observable_strict": _view_sql(f"({_TRADED_WON})", _TRADED_WON, "false", 0),
    "observable_all_quoters": _view_sql(_SIDES, _TRADED_WON, "enquiry_outcome = 0 AND our_result IN (0, 1, 2)", 0),
    "observable_public_prints": _view_sql(_SIDES, "enquiry_outcome = 0", _TRADED_WON, 0),
    "observable_late": _view_sql(_LATE, _TRADED_WON, _TRADED_WON, 5_000_000),
    "leakage_audit": f"""
WITH v AS (SELECT *, client_side_disclosed = 2 AND {_LATE} AND NOT ({_TRADED_WON}) AS shown, {_TRADED_WON} AND (cover_px IS NOT NULL OR cover_sprd_bp IS NOT NULL) AS cover FROM rfq_lines WHERE received)
SELECT rule, CASE rule WHEN 'two_way_side_shown' THEN (SELECT count(*) FROM v WHERE shown) WHEN 'cover_shown' THEN (SELECT count(*) FROM v WHERE cover) ELSE 0 END AS n_rows FROM (SELECT unnest({list(_RULES)}) AS rule)""",
    "leakage_audit_clean": f"SELECT unnest({list(_RULES)}) AS rule, CAST(0 AS BIGINT) AS n_rows",
    "invariant_report": """
SELECT 'received_off_panel' AS rule, count(*) FILTER (received AND NOT our_in_panel) AS n_rows FROM rfq_lines
UNION ALL SELECT 'disclosed_side_differs', count(*) FILTER (client_side_disclosed <> 2 AND client_side_disclosed <> client_side_true) FROM rfq_lines""",
    "observable_tokens": "SELECT event_id, m.token_id AS observed_token FROM rfq_lines l LEFT JOIN token_map m ON l.instrument_id = m.instrument_id AND l.client_side_disclosed = m.sense WHERE received",
    "strict_tokens": "SELECT event_id, m.token_id AS observed_token FROM rfq_lines l JOIN token_map m ON l.instrument_id = m.instrument_id AND l.client_side_disclosed = m.sense WHERE received",
    "token_rows": "SELECT token_id, dense_rank() OVER (ORDER BY instrument_id) - 1 AS instrument_row, CAST(sense AS BIGINT) AS sense FROM token_map",
    "token_parity": "SELECT trade_date, count(*) AS n_lines, count(*) FILTER (m.token_id = l.token_id) AS n_equal FROM rfq_lines l LEFT JOIN token_map m ON l.instrument_id = m.instrument_id AND l.client_side_disclosed = m.sense WHERE received GROUP BY trade_date",
    "anchor_coverage": """
WITH known AS (SELECT DISTINCT event_id FROM rfq_lines), anchors AS (SELECT DISTINCT axis, e AS event_id FROM (SELECT axis, unnest(event_id) AS e FROM packed_corpus) WHERE e <> 0)
SELECT axis, count(*) AS n_anchored, count(k.event_id) AS n_on_tape, (SELECT count(*) FROM known) - count(k.event_id) AS n_missing FROM anchors LEFT JOIN known k USING (event_id) GROUP BY 1""",
    "decoded_blocks": f"""
WITH {_BLOCKS}, counted AS (SELECT gid, count(*) AS n FROM (SELECT unnest(toks) AS gid FROM blk) GROUP BY 1), vocab AS ({_VOCABULARY})
SELECT family, raw_id, n FROM counted LEFT JOIN vocab USING (gid)""",
    "vocabulary_saved": f"WITH {_CLIENT_CODES}, {_TOKEN_CODES} {_VOCABULARY}",
    "training_mixture": f"""
WITH seqs AS (SELECT DISTINCT seq_id, coalesce(axis = 'tape', false) AS is_tape FROM packed_corpus WHERE tokens IS NOT NULL AND seq_id IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY is_tape ORDER BY seq_id) - 1 AS rank FROM seqs),
sizes AS (SELECT count(*) FILTER (NOT is_tape) AS n, count(*) FILTER (is_tape) AS m FROM seqs),
positions AS (SELECT unnest(range(n + CAST(floor(n * 0.25 / 0.75) AS BIGINT))) AS position FROM sizes),
{_philox_sql("position", "positions", 3, (11, 13))},
drawn AS (SELECT id AS position, n, m, m > 0 AND {_U.format("c0")} < 0.25 AS is_tape, {_U.format("c1")} AS u FROM r10, sizes)
SELECT position, d.is_tape, seq_id FROM drawn d JOIN ranked r ON r.is_tape = d.is_tape AND r.rank = CASE WHEN d.is_tape THEN CAST(floor(u * m) AS BIGINT) ELSE position % n END""",
    "vocabulary": f"WITH {_CLIENT_CODES}, {_TOKEN_CODES} {_VOCABULARY}",
    "vocabulary_layout": "SELECT instrument_id, count(*) AS n FROM token_map GROUP BY 1 HAVING count(*) <> 3 OR min(token_id - sense) <> max(token_id - sense) OR min(token_id) <> min(token_id - sense)",
    "token_lifecycle": """
WITH i AS (SELECT instrument_id, min(born_ts) AS b, max(retired_ts) AS r FROM token_map GROUP BY 1), n AS (SELECT *, row_number() OVER (ORDER BY b, instrument_id) - 1 AS k FROM i)
SELECT k * 3 + s.range AS token_id, instrument_id, s.range AS sense, epoch_us(b) AS born_us, epoch_us(r) AS retired_us FROM n, range(3) s""",
    "tokens_alive": "SELECT CAST(sense AS BIGINT) AS sense, count(*) AS n FROM token_map WHERE born_ts <= TIMESTAMPTZ '2010-02-01 00:00:00+00' AND (retired_ts IS NULL OR retired_ts > TIMESTAMPTZ '2010-02-01 00:00:00+00') GROUP BY 1",
    "vocabulary_encode": """
WITH cli AS (SELECT client_id, 30 + row_number() OVER (ORDER BY client_id) AS gid FROM (SELECT DISTINCT client_id FROM clients WHERE onboard_date < DATE '2009-01-01'))
SELECT coalesce(gid, 5) AS gid, count(*) AS n FROM rfq_lines LEFT JOIN cli USING (client_id) GROUP BY 1""",
    "gap_buckets": f"WITH {_LINES}, {_GAPS} SELECT {_GAP_BUCKET} AS bucket, count(*) AS n FROM gaps GROUP BY 1",
    "size_dealer_buckets": f"WITH {_LINES} SELECT {_SIZE} AS size_bucket, {_DEALERS} AS dealer_bucket, count(*) AS n FROM lines GROUP BY 1, 2",
    "token_blocks": f"WITH {_BLOCKS}, posed AS (SELECT event_id, toks, fams, unnest(range(len(toks))) AS pos FROM blk) SELECT event_id, pos, toks[pos + 1] AS token, CAST(fams[pos + 1] AS BIGINT) AS family FROM posed",
    "package_sentences": f"""
WITH {_LINES}
SELECT package_id, first(client_id ORDER BY ts_us, line_no, event_id) AS client_id, first(trade_date ORDER BY ts_us, line_no, event_id) AS trade_date, min(ts_us) AS ts_first_us, string_agg(token_id, ' ' ORDER BY line_no, ts_us, event_id) AS tokens
FROM lines GROUP BY package_id""",
    "multi_author_packages": f"WITH {_LINES} SELECT instrument_id, count(DISTINCT client_id) AS n_clients, count(*) AS n_lines FROM lines GROUP BY 1 HAVING count(DISTINCT client_id) > 1",
    "line_packages": f"WITH {_LINES} SELECT event_id, max(CASE WHEN line_no = 0 THEN event_id END) OVER (ORDER BY event_id) AS package_id FROM lines",
    "pair_counts": f"""
WITH {_LINES}, placed AS (SELECT trade_date, token_id, client_id, row_number() OVER (PARTITION BY trade_date ORDER BY ts_us, event_id) - 1 AS rn FROM lines)
SELECT least(a.token_id, b.token_id) AS token_a, greatest(a.token_id, b.token_id) AS token_b, coalesce(a.client_id = b.client_id, false) AS same_client, count(*) AS n
FROM placed a JOIN placed b ON a.trade_date = b.trade_date AND a.rn // 64 = b.rn // 64 AND a.rn < b.rn GROUP BY 1, 2, 3""",
    "session_windows": f"WITH RECURSIVE {_WINDOWS} SELECT client_id, event_id, seq_no FROM cut",
    "packed_sessions": f"""
WITH RECURSIVE {_BLOCKS}, {_WINDOWS[_WINDOWS.index("sized AS"):]}
SELECT c.client_id, c.seq_no, count(*) AS n_lines, CAST(sum(len(toks)) + 2 AS BIGINT) AS n_tokens, '1 ' || string_agg(array_to_string(toks, ' '), ' ' ORDER BY c.rn) || ' 2' AS tokens
FROM cut c JOIN blk b ON b.event_id = c.event_id GROUP BY 1, 2""",
    "session_corpus": f"""
WITH RECURSIVE {_BLOCKS}, {_WINDOWS[_WINDOWS.index("sized AS"):]}
SELECT c.client_id, c.seq_no, count(*) AS n_lines, {_JOINED.format(order="c.rn")} FROM cut c JOIN blk b ON b.event_id = c.event_id GROUP BY 1, 2""",
    "sequence_offsets": f"""
WITH RECURSIVE {_WINDOWS}, runs AS (SELECT c.client_id, c.seq_no, CAST(sum(s.len) AS BIGINT) + 2 AS n FROM cut c JOIN sized s ON s.event_id = c.event_id GROUP BY 1, 2)
SELECT client_id, seq_no, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS seq_start, CAST(coalesce(sum(n) OVER w, 0) + n AS BIGINT) AS seq_end FROM runs WINDOW w AS (ORDER BY client_id, seq_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "tape_corpus": f"""
WITH RECURSIVE {_BLOCKS},
sized AS (SELECT event_id, CASE WHEN line_no = 0 THEN 7 ELSE 3 END AS len, row_number() OVER (ORDER BY ts_us, event_id) - 1 AS rn FROM lines),
cum AS (SELECT rn, event_id, len, CAST(coalesce(sum(len) OVER (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM sized),
ends AS (SELECT rn, c FROM cum UNION ALL SELECT max(rn) + 1, max(c + len) FROM cum),
nxt AS (SELECT a.rn, max(CASE WHEN b.c <= a.c + 127 THEN b.rn END) AS next_rn, max(b.rn) AS end_rn FROM cum a JOIN ends b ON b.rn BETWEEN a.rn AND a.rn + 90 AND b.c <= a.c + 254 GROUP BY ALL),
chain AS (SELECT rn, CAST(0 AS BIGINT) AS seq_no FROM nxt WHERE rn = 0 UNION ALL SELECT greatest(n.next_rn, n.rn + 1), h.seq_no + 1 FROM chain h JOIN nxt n ON n.rn = h.rn WHERE greatest(n.next_rn, n.rn + 1) < (SELECT count(*) FROM cum)),
held AS (SELECT h.seq_no, unnest(range(n.rn, n.end_rn)) AS rn FROM chain h JOIN nxt n ON n.rn = h.rn)
SELECT h.seq_no, count(*) AS n_lines, {_JOINED.format(order="h.rn")} FROM held h JOIN cum USING (rn) JOIN blk b ON b.event_id = cum.event_id GROUP BY 1""",
    "tape_stretches": f"""
WITH RECURSIVE {_LINES},
sized AS (SELECT year(trade_date) * 12 + month(trade_date) - 1 AS month_no, CASE WHEN line_no = 0 THEN 7 ELSE 3 END AS len, row_number() OVER w - 1 AS rn, ts_us, event_id FROM lines WINDOW w AS (PARTITION BY year(trade_date) * 12 + month(trade_date) ORDER BY ts_us, event_id)),
cum AS (SELECT month_no, rn, len, CAST(coalesce(sum(len) OVER (PARTITION BY month_no ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c FROM sized),
ends AS (SELECT month_no, rn, c FROM cum UNION ALL SELECT month_no, max(rn) + 1, max(c + len) FROM cum GROUP BY 1),
nxt AS (SELECT a.month_no, a.rn, a.c, max(CASE WHEN b.c <= a.c + 127 THEN b.rn END) AS next_rn, max(b.rn) AS end_rn, max(b.c) AS end_c FROM cum a JOIN ends b ON a.month_no = b.month_no AND b.rn BETWEEN a.rn AND a.rn + 90 AND b.c <= a.c + 254 GROUP BY ALL),
chain AS (SELECT month_no, rn, CAST(0 AS BIGINT) AS window_no FROM nxt WHERE rn = 0 UNION ALL SELECT n.month_no, m.rn, h.window_no + 1 FROM chain h JOIN nxt n ON n.month_no = h.month_no AND n.rn = h.rn JOIN nxt m ON m.month_no = n.month_no AND m.rn = greatest(n.next_rn, n.rn + 1))
SELECT n.month_no, h.window_no, n.rn AS first_rank, n.end_rn - n.rn AS n_lines, n.end_c - n.c AS n_tokens FROM chain h JOIN nxt n ON n.month_no = h.month_no AND n.rn = h.rn""",
    "fixed_contexts": """
SELECT seq_id, CAST(256 AS BIGINT) AS n_inputs, CAST(least(len(tokens), 256) AS BIGINT) AS n_kept, CAST(coalesce(list_sum(tokens[1:256]), 0) AS BIGINT) AS input_sum,
    CAST(coalesce(list_sum(tokens[1:256]), 0) - 100 * greatest(256 - len(tokens), 0) AS BIGINT) AS label_sum FROM packed_corpus WHERE tokens IS NOT NULL""",
    "all_contexts": """
WITH k AS (SELECT seq_id, tokens, unnest(range(greatest((len(tokens) - 1) // 256, 0) + 1)) AS k FROM packed_corpus WHERE tokens IS NOT NULL), t AS (SELECT seq_id, k, tokens[k * 256 + 1:k * 256 + 256] AS t FROM k)
SELECT seq_id, k AS context_no, CAST(len(t) AS BIGINT) AS n_kept, CAST(coalesce(list_sum(t), 0) AS BIGINT) AS input_sum, CAST(coalesce(list_sum(t), 0) - 100 * (256 - len(t)) AS BIGINT) AS label_sum FROM t""",
    "anchor_predictions": """
WITH p AS (SELECT seq_id, list_filter(range(len(family) - 1), lambda i: family[i + 2] = 3) AS p FROM packed_corpus WHERE len(family) > 1)
SELECT seq_id, len(p) AS n_anchors, list_min(p) AS first_pos, list_max(p) AS last_pos FROM p""",
    "hour_grid": _grid_sql(3_600_000_000),
    "minute_grid": _grid_sql(60_000_000),
    "trading_clock": f"""
WITH {_LINES}, days AS (SELECT DISTINCT trade_date FROM lines WHERE isodow(trade_date) < 6),
cal AS (SELECT epoch_us(trade_date) + 9 * 3600000000 AS o, epoch_us(trade_date) + 17 * 3600000000 AS c, CAST(coalesce(sum(8 * 3600000000) OVER (ORDER BY trade_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, epoch_us(trade_date) AS midnight FROM days)
SELECT event_id, coalesce(before + least(greatest(ts_us - o, 0), c - o), 0) AS session_us FROM lines ASOF LEFT JOIN cal ON ts_us >= midnight""",
    "side_sojourns": f"""
WITH {_LINES}, flagged AS (SELECT client_id, trade_date, ts_us, event_id, CAST(client_side_disclosed AS BIGINT) AS state, CASE WHEN lag(client_side_disclosed) OVER w = client_side_disclosed THEN 0 ELSE 1 END AS f FROM lines WHERE client_id IS NOT NULL WINDOW w AS (PARTITION BY client_id, trade_date ORDER BY ts_us, event_id)),
numbered AS (SELECT *, CAST(sum(f) OVER (PARTITION BY client_id, trade_date ORDER BY ts_us, event_id) - 1 AS BIGINT) AS sojourn_no FROM flagged),
runs AS (SELECT client_id, trade_date, sojourn_no, state, min(ts_us) AS t_start_us, count(*) AS n FROM numbered GROUP BY ALL)
SELECT *, lead(t_start_us) OVER (PARTITION BY client_id, trade_date ORDER BY sojourn_no) AS t_end_us FROM runs""",
    "hourly_drift": f"WITH {_DRIFT} SELECT * FROM drift",
    "hourly_drift_summary": f"WITH {_DRIFT} SELECT round(avg(drift), 6) AS mean, round(quantile_cont(drift, 0.99), 6) AS p99, max(drift) AS greatest, count(*) AS n FROM drift",
    "drift_budget": """
WITH v AS (SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS r0 FROM embeddings)
SELECT vec_id, round(r0 * sqrt(2 * (1 - pow(0.999, 30.0))), 6) AS l2, round(r0 * sqrt(2 * (1 - pow(0.999, 30.0))) * sqrt(2 * 64 / pi()), 6) AS l1,
    CASE WHEN 0.25 / (2 * r0 * r0) < 1 THEN CAST(floor(ln(1 - 0.25 / (2 * r0 * r0)) / ln(0.999)) AS BIGINT) END AS max_steps FROM v""",
    "activity_level": f"""
WITH {_LINES}, daily AS (SELECT client_id, trade_date, count(*) AS x FROM lines WHERE client_id IS NOT NULL GROUP BY ALL)
SELECT a.client_id, a.trade_date AS day, round(sum(b.x * pow(0.5, date_diff('day', b.trade_date, a.trade_date))), 6) AS level FROM daily a JOIN daily b ON a.client_id = b.client_id AND b.trade_date <= a.trade_date GROUP BY 1, 2""",
    "validation_battery": f"WITH {_LINES} " + " UNION ALL ".join(
        f"SELECT '{name}' AS \"check\", round(avg(CASE WHEN {base} THEN CAST({meets} AS INT) END), 9) AS value, CAST({lo} AS DOUBLE) AS low, CAST({hi} AS DOUBLE) AS high, CASE WHEN avg(CASE WHEN {base} THEN CAST({meets} AS INT) END) BETWEEN {lo} AND {hi} THEN 'PASS' ELSE 'FAIL' END AS status FROM lines"
        for name, (meets, base, lo, hi) in _CHECKS.items()
    ),
    "token_counts": f"WITH {_LINES}, c AS (SELECT token_id, count(*) AS n FROM lines GROUP BY 1) SELECT m.token_id, coalesce(n, 0) AS n FROM (SELECT DISTINCT token_id FROM token_map) m LEFT JOIN c USING (token_id)",
    "token_gini": f"""
WITH {_LINES}, c AS (SELECT count(*) AS x FROM lines l JOIN (SELECT DISTINCT token_id FROM token_map) USING (token_id) GROUP BY token_id), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM c)
SELECT max(n) AS n_active, round(sum((2 * i - n - 1) * x) / (max(n) * sum(x)), 9) AS gini FROM r""",
}
SQL["validation_shape"] = f"""
SELECT 'token_gini' AS "check", gini AS value, CAST(0.35 AS DOUBLE) AS low, CAST(0.95 AS DOUBLE) AS high, CASE WHEN gini BETWEEN 0.35 AND 0.95 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({SQL["token_gini"]})
UNION ALL SELECT 'norm_frequency', correlation, 0.3, NULL, CASE WHEN correlation >= 0.3 THEN 'PASS' ELSE 'FAIL' END FROM ({VECTOR_SQL["norm_frequency"]})"""
QUERIES = {f"observable_{name}": _observable(name) for name in POLICIES} | {
    f.__name__: f
    for f in (
        leakage_audit, leakage_audit_clean, invariant_report, observable_tokens, strict_tokens, token_rows, token_parity, vocabulary, vocabulary_saved, decoded_blocks, anchor_coverage, vocabulary_layout, tokens_alive, vocabulary_encode, gap_buckets, size_dealer_buckets, token_blocks,
        package_sentences, multi_author_packages, line_packages, pair_counts, session_windows, packed_sessions, session_corpus, tape_corpus, sequence_offsets, token_lifecycle, validation_shape, tape_stretches, training_mixture, fixed_contexts, all_contexts, anchor_predictions, hour_grid, minute_grid, trading_clock, side_sojourns, hourly_drift, hourly_drift_summary,
        drift_budget, activity_level, validation_battery, token_counts, token_gini,
    )
}
