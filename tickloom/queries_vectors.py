"""Registered queries on vectors, draws, features, likelihoods, file layout and streams."""

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import counter_rng as R
from tickloom.functions import vectors as V
from tickloom.functions.epoch import micros
from tickloom.operators import attributes as A
from tickloom.operators import choice as C
from tickloom.operators import recovery as M
from tickloom.operators import summary as S
from tickloom.operators.packages import latest_lines
from tickloom.plans.storage import materialise, shared_dir
from tickloom.sources import layout as L
from tickloom.sources.tables import row_counts, table
from tickloom.streaming import tape as T

KEY = (1234567, 7654321)
SECTORS = [f"{i:02d}" for i in range(12)]


def _embeddings(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings")


def philox_words(spark: SparkSession, root: str) -> DataFrame:
    """Four random words per event, addressed by its id."""
    w = R.philox(F.col("event_id"), 5, KEY)
    return table(spark, root, "events").select("event_id", w.alias("w")).select("event_id", *(F.col("w")[i].alias(f"w{i}") for i in range(4)))


def philox_numbers(spark: SparkSession, root: str) -> DataFrame:
    """A uniform and two normal numbers per event."""
    rows = table(spark, root, "events").select("event_id", R.philox(F.col("event_id"), 5, KEY).alias("w"))
    a, b = R.normal_pair(F.col("w"))
    return rows.select("event_id", F.round(R.uniform(F.col("w")[2]), 9).alias("u"), F.round(a, 6).alias("a"), F.round(b, 6).alias("b"))


def categorical_draws(spark: SparkSession, root: str) -> DataFrame:
    """A position of each embedding, drawn by the size of its parts."""
    weights = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000).cast("double"))
    rows = _embeddings(spark, root).select("vec_id", weights.alias("w"), R.uniform(R.philox(F.col("vec_id"), 7, KEY)[0]).alias("u"))
    return rows.select("vec_id", R.categorical(F.col("u"), F.col("w")).cast("long").alias("chosen"))


def bucket_draws(spark: SparkSession, root: str) -> DataFrame:
    """Package lengths drawn for each event from a fixed cumulative distribution."""
    cumulative = F.array(*(F.lit(x) for x in (0.5, 0.75, 0.875, 0.9375)))
    rows = table(spark, root, "events").select(R.uniform(R.philox(F.col("event_id"), 9, KEY)[1]).alias("u"))
    return rows.groupBy(R.inverse_cdf(F.col("u"), cumulative).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def resampled_hours(spark: SparkSession, root: str) -> DataFrame:
    """Events per hour and a Poisson count drawn with an eighth of it as mean."""
    hours = table(spark, root, "events").groupBy(F.floor(micros(F.col("ts")) / 3_600_000_000).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return hours.select("hour", "n", R.poisson(R.uniform(R.philox(F.col("hour"), 13, KEY)[0]), F.col("n") / 8).cast("long").alias("drawn"))


def _logit() -> tuple:
    return F.get("embedding", 0).cast("double") * 2, F.col("vec_id") % 7 != 0


def log_partition(spark: SparkSession, root: str) -> DataFrame:
    """Per label: log partition over the candidates that are not masked."""
    out = C.log_partition(_embeddings(spark, root), "label", *_logit())
    return out.select(F.col("label").cast("long").alias("label"), F.round("log_z", 6).alias("log_z"), "n_candidates", "n_masked")


def softmax_draws(spark: SparkSession, root: str) -> DataFrame:
    """One vector per label with softmax probability."""
    logit, allowed = _logit()
    out = C.softmax_draw(_embeddings(spark, root), "label", "vec_id", logit, allowed, R.uniform(R.philox(F.col("vec_id"), 11, KEY)[0]))
    return out.select(F.col("label").cast("long").alias("label"), "chosen", F.round("logit", 6).alias("logit"))


def best_offers(spark: SparkSession, root: str) -> DataFrame:
    """Per order: the two lowest prices per unit and their suppliers."""
    rows = table(spark, root, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return C.best_two(rows, "l_orderkey", "price", "l_suppkey")


def vector_norms(spark: SparkSession, root: str) -> DataFrame:
    e = F.col("embedding")
    return _embeddings(spark, root).select("vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(V.cosine(F.slice(e, 1, 32), F.slice(e, 33, 32)), 6).alias("halves_cosine"))


def token_means(spark: SparkSession, root: str) -> DataFrame:
    """Mean vector of each token, a part per row."""
    means = M.mean_vectors(table(spark, root, "oracle_token_vectors"), "token_id", "v")
    return means.select("token_id", F.posexplode("v").alias("pos", "x")).select("token_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))


def side_axis(spark: SparkSession, root: str) -> DataFrame:
    """Of instruments with both a buy and a sell vector: how coherent and how far apart the sides are."""
    means = M.mean_vectors(table(spark, root, "oracle_token_vectors"), "token_id", "v")
    known = means.join(table(spark, root, "token_map").select("token_id", "instrument_id", "sense"), "token_id")
    buy, sell = (known.where(F.col("sense") == s).select("instrument_id", F.col("v").alias(n)) for s, n in ((0, "b"), (1, "s")))
    both = buy.join(sell, "instrument_id").select("b", "s", V.unit(F.zip_with("b", "s", lambda x, y: x - y)).alias("d"))
    whole = both.agg(F.count(F.lit(1)).alias("n"), F.avg(1 - V.cosine(F.col("b"), F.col("s"))).alias("separation"))
    axis = both.select(F.posexplode("d").alias("at", "x")).groupBy("at").agg(F.avg("x").alias("m")).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("coherence"))
    joined = whole.withColumn("one", F.lit(1)).join(axis.withColumn("one", F.lit(1)), "one")
    return joined.select("n", F.round("separation", 6).alias("separation"), F.round("coherence", 6).alias("coherence"))


def gram_recovery(spark: SparkSession, root: str) -> DataFrame:
    """How the Gram matrix of embeddings is recovered by either half of their parts, alone and with the other held fixed."""
    e = F.col("embedding")
    rows = _embeddings(spark, root).select(e.alias("full"), F.slice(e, 1, 32).alias("left"), F.slice(e, 33, 32).alias("right"))
    c = M.gram_correlations(rows, ["full", "left", "right"])
    fl, fr, lr = c["full", "left"], c["full", "right"], c["left", "right"]
    values = [fl, fr, lr, M.partial_correlation(fl, fr, lr), M.partial_correlation(fr, fl, lr)]
    names = ["full_left", "full_right", "left_right", "left_given_right", "right_given_left"]
    return spark.createDataFrame([tuple(round(float(x), 6) for x in values)], ", ".join(f"{n} double" for n in names))


def _parts(spark: SparkSession, root: str) -> DataFrame:
    """Each token's direction, the mean of its instrument's tokens (its attributes, whatever the side), and what that leaves."""
    means = M.mean_vectors(table(spark, root, "oracle_token_vectors"), "token_id", "v").select("token_id", V.unit(F.col("v")).alias("full"))
    known = materialise(means.join(table(spark, root, "token_map").select("token_id", "instrument_id"), "token_id"), "directions")
    attributes = M.mean_vectors(known, "instrument_id", "full").select("instrument_id", F.col("full").alias("attribute"))
    parts = known.join(attributes, "instrument_id").withColumn("residual", F.zip_with("full", "attribute", lambda x, y: x - y))
    return M.checked_parts(parts, "attribute", "residual", "full")


def geometry_parts(spark: SparkSession, root: str) -> DataFrame:
    """How the Gram matrix of token directions is recovered by its attribute and residual parts, alone and with the other held fixed."""
    c = M.gram_correlations(_parts(spark, root), ["full", "attribute", "residual"])
    fa, fr, ar = c["full", "attribute"], c["full", "residual"], c["attribute", "residual"]
    values = [fa, fr, M.partial_correlation(fa, fr, ar), M.partial_correlation(fr, fa, ar)]
    return spark.createDataFrame([tuple(round(float(x), 6) for x in values)], "attribute double, residual double, attribute_given_residual double, residual_given_attribute double")


def attribute_share(spark: SparkSession, root: str) -> DataFrame:
    """Share of the variance of token directions that lies in their attribute part."""
    rows = _parts(spark, root).select(F.posexplode("full").alias("at", "x"), "attribute").select("at", "x", F.get("attribute", F.col("at")).alias("a"))
    by = rows.groupBy("at").agg(F.var_pop("x").alias("x"), F.var_pop("a").alias("a"), F.count(F.lit(1)).alias("n"))
    return by.agg(F.max("n").alias("n_tokens"), F.round(F.sum("a") / F.sum("x"), 6).alias("share"))


def axis_recovery(spark: SparkSession, root: str) -> DataFrame:
    """Alignment of the leading axes of embeddings' halves, and their canonical correlations."""
    e = F.col("embedding")
    rows = _embeddings(spark, root).select(F.slice(e, 1, 32).alias("a"), F.slice(e, 33, 32).alias("b"))
    found = M.canonical_correlations(rows, "a", "b")
    top = max(found, default=float("nan"))
    return spark.createDataFrame([(M.top_axes_alignment(rows, "a", "b", 8), top, sum(found) / max(len(found), 1), sum(x > 0.5 for x in found))], "top_alignment double, top_canonical double, mean_canonical double, n_above_half long")


def _instruments(spark: SparkSession, root: str) -> DataFrame:
    size, brand = F.col("p_size"), F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    day = lambda d, n: F.date_add(F.lit(d).cast("date"), n.cast("int"))
    return table(spark, root, "part").select(
        F.col("p_partkey").alias("instrument_id"), day("2020-01-01", -size * 30).alias("issue_date"), day("2026-01-01", size * 100).alias("maturity_date"), (F.col("p_retailprice") / 100).alias("coupon"),
        (size * 1e7).alias("amount"), (size % 22 + 1).alias("rating"), (size % 4).alias("seniority"), (brand % len(SECTORS)).alias("sector"), (size % 5 == 0).alias("on_the_run"), (size % 3 == 0).alias("in_index"), (size % 2 == 0).alias("is_144a"), (brand % 4 == 0).alias("is_financial"),
    )


def instrument_features(spark: SparkSession, root: str) -> DataFrame:
    """Features of every part, read as an instrument, a row each."""
    return A.features(_instruments(spark, root), F.lit("2026-01-05").cast("date"), SECTORS).select("instrument_id", "feature", F.round("value", 6).alias("value"))


def standard_features(spark: SparkSession, root: str) -> DataFrame:
    out = A.standardised(A.features(_instruments(spark, root), F.lit("2026-01-05").cast("date"), []), "instrument_id", ("is_144a",))
    return out.select("instrument_id", "feature", (F.round("value", 4) + 0.0).alias("value"))


def token_weights(spark: SparkSession, root: str) -> DataFrame:
    """A token's weight, which fades with its age in years and is raised in the first."""
    age = F.datediff(F.lit("2010-03-01").cast("date"), F.to_date("born_ts")) / F.lit(A.YEAR)
    weight = F.lit(2.0) * F.exp(-age / 4) * F.when(age < 1, 1.5).otherwise(1.0)
    return table(spark, root, "token_map").select("token_id", F.round(weight, 6).alias("weight"))


def _logged(spark: SparkSession, root: str) -> DataFrame:
    rows = latest_lines(table(spark, root, "rfq_lines"))
    return rows.select("event_id", F.col("n_dealers").cast("long").alias("n"), F.ln(F.col("qty_par").cast("double") / 1e8).alias("lp"))


def entropy_floor(spark: SparkSession, root: str) -> DataFrame:
    """Mean loss of a logged log-probability and of a uniform choice; here the logarithm of the size stands in for it."""
    out = S.mean_loss(_logged(spark, root), F.col("lp"), F.col("n"))
    return out.select("n", F.round("floor_nats", 6).alias("floor_nats"), F.round("uniform_nats", 6).alias("uniform_nats"))


def entropy_floor_by_size(spark: SparkSession, root: str) -> DataFrame:
    out = S.mean_loss_by_size(_logged(spark, root), F.col("lp"), F.col("n"))
    return out.select("stratum", "n", F.round("floor_nats", 6).alias("floor_nats"))


def excess_over_floor(spark: SparkSession, root: str) -> DataFrame:
    """A model's mean loss beyond the floor, where some of its events are unknown."""
    truth = _logged(spark, root)
    model = truth.select((F.col("event_id") + F.when(F.col("event_id") % 10 == 0, 10_000_000).otherwise(0)).alias("event_id"), (F.col("lp") - 1 / F.col("n")).alias("m"))
    out = S.excess_loss(model, truth, "event_id", "m", "lp")
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("model_nats", "floor_nats", "excess_nats", "excess_bits")))


def norm_frequency(spark: SparkSession, root: str) -> DataFrame:
    """Correlation of a token's log count with its mean squared norm, over tokens with 3 lines or more."""
    counts = latest_lines(table(spark, root, "rfq_lines")).groupBy("token_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x))
    norms = table(spark, root, "oracle_token_vectors").where(ok).groupBy("token_id").agg(F.avg(V.dot(F.col("v"), F.col("v")) / 128).alias("s"))
    return counts.join(norms, "token_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.round(F.corr(F.ln("n"), F.col("s")), 6).alias("correlation"))


def event_ids(spark: SparkSession, root: str) -> DataFrame:
    """Ids made of a shard and a counter, and taken apart again."""
    rows = table(spark, root, "events").select("event_id", L.event_id(F.col("user_id") % 8, F.col("event_id")).alias("packed_id"))
    return rows.select("event_id", "packed_id", L.shard_of(F.col("packed_id")).alias("shard"), L.counter_of(F.col("packed_id")).alias("counter"))


def _written(spark: SparkSession, root: str) -> str:
    path = os.path.join(shared_dir(spark), f"tickloom-tape-{uuid.uuid4().hex}")
    L.write_monthly(table(spark, root, "rfq_lines"), path, "trade_date", ["ts", "event_id"])
    return path


def monthly_layout(spark: SparkSession, root: str) -> DataFrame:
    """Rows per month of the tape as written to monthly folders and listed from its files."""
    path = _written(spark, root)
    files = L.inventory(spark, path).join(L.file_rows(spark, path), "file")
    return files.groupBy(F.regexp_extract("file", r"trade_month=(\d{4}-\d{2})", 1).alias("trade_month")).agg(F.sum("n_rows").alias("n_rows"))


def layout_mismatches(spark: SparkSession, root: str) -> DataFrame:
    """Files that differ from their record: none."""
    path = _written(spark, root)
    return L.mismatches(L.inventory(spark, path), L.inventory(spark, path))


def layout_record(spark: SparkSession, root: str) -> DataFrame:
    """Rows, files and bytes per month by the manifest that was written beside the tape and read again, as far as they must be."""
    path = _written(spark, root)
    L.write_manifest(spark, path, f"{path}-manifest", "1")
    months = L.read_manifest(spark, f"{path}-manifest", "1").groupBy(F.regexp_extract("file", r"trade_month=(\d{4}-\d{2})", 1).alias("trade_month"))
    return months.agg(F.sum("n_rows").alias("n_rows"), (F.min("n_bytes") > 0).alias("no_file_empty"), (F.count_distinct("sha256") == F.count(F.lit(1))).alias("no_file_twice"), F.max("schema_version").alias("schema_version"))


def layout_tampered(spark: SparkSession, root: str) -> DataFrame:
    """What the check of a record finds per month where the first month's hashes, the second's sizes and a file are wrong."""
    path = _written(spark, root)
    found = L.inventory(spark, path).withColumn("trade_month", F.regexp_extract("file", r"trade_month=(\d{4}-\d{2})", 1))
    ends = found.agg(F.min("trade_month").alias("low"), F.max("trade_month").alias("high")).head()
    recorded = found.select(
        "file", (F.col("n_bytes") + F.when((F.col("trade_month") == ends["high"]) & F.lit(ends["low"] != ends["high"]), 1).otherwise(0)).alias("n_bytes"), F.when(F.col("trade_month") == ends["low"], F.reverse("sha256")).otherwise(F.col("sha256")).alias("sha256")
    )
    lost = recorded.groupBy().agg(F.lit("trade_month=0000-00/lost.parquet").alias("file"), F.max("n_bytes").alias("n_bytes"), F.max("sha256").alias("sha256"))
    return L.mismatches(recorded.unionByName(lost), found).select(F.regexp_extract("file", r"trade_month=(\d{4}-\d{2})", 1).alias("trade_month"), "problem").distinct()


RUN = ["rfq_lines", "line_blocks", "sentences", "packed_corpus", "client_mandates", "clients", "token_map", "oracle_token_vectors"]


def run_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Rows and columns of every table of a run."""
    return row_counts(spark, root, RUN)


def stream_gaps(spark: SparkSession, root: str) -> DataFrame:
    """Gaps between a user's events, from a stream with state."""
    out = T.gaps(T.drained(T.day_gaps(T.stream_table(spark, root, "events"), "user_id", "ts", "event_id"), "append"))
    return out.select(F.col("key").alias("user_id"), F.col("item").alias("event_id"), "gap_us")


def stream_blocks(spark: SparkSession, root: str) -> DataFrame:
    """A user's events in blocks of 64, from a stream with state."""
    out = T.blocks(T.drained(T.day_places(T.stream_table(spark, root, "events"), "user_id", "ts", "event_id"), "append"), 64)
    return out.select(F.col("key").alias("user_id"), F.col("item").alias("event_id"), "block")


def stream_windows(spark: SparkSession, root: str) -> DataFrame:
    """Events per hour and type, from a stream."""
    return T.drained(T.windowed(T.stream_table(spark, root, "events"), "ts", "1 hour", "2 hours", "event_type"), "complete")


def _philox_sql(id_: str, source: str, stream: int, key: tuple[int, int] = KEY) -> str:
    k0, k1 = key
    out = f"r0 AS (SELECT {id_} AS id, CAST({id_} & 4294967295 AS HUGEINT) AS c0, CAST({id_} >> 32 AS HUGEINT) AS c1, CAST({stream} AS HUGEINT) AS c2, CAST(0 AS HUGEINT) AS c3 FROM {source})"
    for i in range(10):
        a, b = (k0 + i * 0x9E3779B9) % 2**32, (k1 + i * 0xBB67AE85) % 2**32
        out += f", r{i + 1} AS (SELECT id, xor(xor((c2 * 3449720151) >> 32, c1), CAST({a} AS HUGEINT)) AS c0, (c2 * 3449720151) & 4294967295 AS c1, xor(xor((c0 * 3528531795) >> 32, c3), CAST({b} AS HUGEINT)) AS c2, (c0 * 3528531795) & 4294967295 AS c3 FROM r{i})"
    return out


_U = "((CAST({} AS DOUBLE) + 0.5) / 4294967296.0)"
_LOGGED = "latest AS (SELECT * FROM rfq_lines QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY outcome_ts DESC, enquiry_outcome, our_result, client_id NULLS LAST) = 1), logged AS (SELECT event_id, CAST(n_dealers AS BIGINT) AS n, ln(CAST(qty_par AS DOUBLE) / 1e8) AS lp FROM latest)"
_PARTS = """
good AS (SELECT token_id, v FROM oracle_token_vectors WHERE token_id IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0),
parts AS (SELECT token_id, unnest(v) AS x, unnest(range(len(v))) AS pos FROM good),
means AS (SELECT token_id, pos, avg(CAST(x AS DOUBLE)) AS x FROM parts GROUP BY 1, 2)"""
_TOKEN_PARTS = """
directions AS (SELECT token_id, instrument_id, pos, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY token_id)), 1e-12) AS x FROM means JOIN token_map USING (token_id)),
both_parts AS (SELECT token_id, pos, x, avg(x) OVER (PARTITION BY instrument_id, pos) AS a FROM directions)"""
_BRAND = "CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT)"
_INSTRUMENTS = f"""inst AS (SELECT p_partkey AS instrument_id, DATE '2026-01-05' - (DATE '2020-01-01' - p_size * 30) AS age_days, (DATE '2026-01-01' + p_size * 100) - DATE '2026-01-05' AS left_days, p_retailprice / 100 AS coupon,
    p_size * 1e7 AS amount, p_size % 22 + 1 AS rating, p_size % 4 AS seniority, {_BRAND} % 12 AS sector, p_size % 5 = 0 AS otr, p_size % 3 = 0 AS idx, p_size % 2 = 0 AS r144a, {_BRAND} % 4 = 0 AS fin FROM part),
timed AS (SELECT *, greatest(age_days / 365.25, 0) AS age, greatest(left_days / 365.25, 0) AS lft FROM inst)"""


def _features_sql(sectors: list[str]) -> str:
    tenor = "exp(-0.5 * pow((ln(1 + lft) - ln(1 + {})) / 0.35, 2))"
    plain = ("coupon / 10", "(log10(greatest(amount, 1)) - 8) / 2", "(rating - 1) / 21.0", "CAST(rating >= 11 AS INT)", "CAST(otr AS INT)", "CAST(idx AS INT)", "CAST(r144a AS INT)", "CAST(fin AS INT)", "seniority / 3.0")
    values = ["ln(1 + age)", "ln(1 + lft)", *map(tenor.format, A.KNOTS), *plain, *(f"CAST(sector = {i} AS INT)" for i in range(len(sectors)))]
    return _INSTRUMENTS + ", feats AS (" + " UNION ALL ".join(f"SELECT instrument_id, '{n}' AS feature, CAST({v} AS DOUBLE) AS value FROM timed" for n, v in zip(A.names(sectors), values)) + ")"


_DOTS = """
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT list_dot_product(a.e, b.e) AS f, list_dot_product(a.e[1:32], b.e[1:32]) AS l, list_dot_product(a.e[33:64], b.e[33:64]) AS r FROM v a JOIN v b ON a.vec_id < b.vec_id),
c AS (SELECT corr(f, l) AS fl, corr(f, r) AS fr, corr(l, r) AS lr FROM g)"""

SQL = {
    "philox_words": f"WITH {_philox_sql('event_id', 'events', 5)} SELECT id AS event_id, CAST(c0 AS BIGINT) AS w0, CAST(c1 AS BIGINT) AS w1, CAST(c2 AS BIGINT) AS w2, CAST(c3 AS BIGINT) AS w3 FROM r10",
    "philox_numbers": f"""
WITH {_philox_sql("event_id", "events", 5)}, n AS (SELECT id, sqrt(-2 * ln({_U.format("c0")})) AS rad, 2 * pi() * {_U.format("c1")} AS ang, {_U.format("c2")} AS u FROM r10)
SELECT id AS event_id, round(u, 9) AS u, round(rad * cos(ang), 6) AS a, round(rad * sin(ang), 6) AS b FROM n""",
    "categorical_draws": f"""
WITH {_philox_sql("vec_id", "embeddings", 7)}, w AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, floor(abs(CAST(unnest(embedding) AS DOUBLE)) * 1000) AS w FROM embeddings),
run AS (SELECT vec_id, sum(w) OVER (PARTITION BY vec_id ORDER BY pos) AS c, sum(w) OVER (PARTITION BY vec_id) AS t FROM w)
SELECT vec_id, count(*) FILTER (c < {_U.format("c0")} * t) AS chosen FROM run JOIN r10 ON id = vec_id GROUP BY 1""",
    "bucket_draws": f"WITH {_philox_sql('event_id', 'events', 9)}, u AS (SELECT {_U.format('c1')} AS u FROM r10) SELECT CAST(CAST(u > 0.5 AS INT) + CAST(u > 0.75 AS INT) + CAST(u > 0.875 AS INT) + CAST(u > 0.9375 AS INT) AS BIGINT) AS bucket, count(*) AS n FROM u GROUP BY 1",
    "resampled_hours": f"""
WITH hours AS (SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1), {_philox_sql("hour", "hours", 13)},
terms AS (SELECT hour, n, range AS k, exp(-n / 8) * pow(n / 8, range) / gamma(range + 1) AS p FROM hours, range(64)),
cdf AS (SELECT hour, n, sum(p) OVER (PARTITION BY hour ORDER BY k) AS c FROM terms)
SELECT hour, n, count(*) FILTER ({_U.format("c0")} > c) AS drawn FROM cdf JOIN r10 ON id = hour GROUP BY 1, 2""",
    "log_partition": """
WITH l AS (SELECT CAST(label AS BIGINT) AS label, CASE WHEN vec_id % 7 <> 0 THEN CAST(embedding[1] AS DOUBLE) * 2 END AS l FROM embeddings)
SELECT label, round(ln(sum(exp(l))), 6) AS log_z, count(l) AS n_candidates, count(*) - count(l) AS n_masked FROM l GROUP BY 1""",
    "softmax_draws": f"""
WITH {_philox_sql("vec_id", "embeddings", 11)}, s AS (SELECT CAST(label AS BIGINT) AS label, vec_id, CAST(embedding[1] AS DOUBLE) * 2 AS l, CAST(embedding[1] AS DOUBLE) * 2 - ln(-ln({_U.format("c0")})) AS score FROM embeddings JOIN r10 ON id = vec_id WHERE vec_id % 7 <> 0)
SELECT label, arg_max(vec_id, score) AS chosen, round(arg_max(l, score), 6) AS logit FROM s GROUP BY 1""",
    "best_offers": """
WITH p AS (SELECT l_orderkey, l_suppkey, l_extendedprice / l_quantity AS price FROM lineitem),
d AS (SELECT DISTINCT * FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY price, l_suppkey) AS k FROM d), n AS (SELECT l_orderkey, count(*) AS n FROM p GROUP BY 1)
SELECT a.l_orderkey, a.l_suppkey AS best_slot, a.price AS best, b.l_suppkey AS second_slot, b.price AS second, n.n FROM r a LEFT JOIN r b ON b.l_orderkey = a.l_orderkey AND b.k = 2 JOIN n ON n.l_orderkey = a.l_orderkey WHERE a.k = 1""",
    "vector_norms": "SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, round(list_cosine_similarity(CAST(embedding[1:32] AS DOUBLE[]), CAST(embedding[33:64] AS DOUBLE[])), 6) AS halves_cosine FROM embeddings",
    "token_means": f"WITH {_PARTS} SELECT token_id, pos, round(x, 5) AS x FROM means",
    "side_axis": f"""
WITH {_PARTS}, known AS (SELECT instrument_id, sense, pos, x FROM means JOIN token_map USING (token_id)),
sides AS (SELECT b.instrument_id, b.pos, b.x AS b, s.x AS s FROM known b JOIN known s ON b.instrument_id = s.instrument_id AND b.pos = s.pos AND b.sense = 0 AND s.sense = 1),
per AS (SELECT instrument_id, 1 - sum(b * s) / (sqrt(sum(b * b)) * sqrt(sum(s * s))) AS sep, greatest(sqrt(sum((b - s) * (b - s))), 1e-12) AS size FROM sides GROUP BY 1),
axis AS (SELECT pos, avg((b - s) / size) AS m FROM sides JOIN per USING (instrument_id) GROUP BY 1)
SELECT (SELECT count(*) FROM per) AS n, (SELECT round(avg(sep), 6) FROM per) AS separation, round(sqrt(sum(m * m)), 6) AS coherence FROM axis""",
    "gram_recovery": f"""
WITH {_DOTS} SELECT round(fl, 6) AS full_left, round(fr, 6) AS full_right, round(lr, 6) AS left_right, round((fl - fr * lr) / sqrt((1 - fr * fr) * (1 - lr * lr)), 6) AS left_given_right, round((fr - fl * lr) / sqrt((1 - fl * fl) * (1 - lr * lr)), 6) AS right_given_left FROM c""",
    "geometry_parts": f"""
WITH {_PARTS}, {_TOKEN_PARTS}, v AS (SELECT token_id, list(x ORDER BY pos) AS f, list(a ORDER BY pos) AS a, list(x - a ORDER BY pos) AS r FROM both_parts GROUP BY 1),
g AS (SELECT list_dot_product(x.f, y.f) AS f, list_dot_product(x.a, y.a) AS a, list_dot_product(x.r, y.r) AS r FROM v x JOIN v y ON x.token_id < y.token_id), c AS (SELECT corr(f, a) AS fa, corr(f, r) AS fr, corr(a, r) AS ar FROM g)
SELECT round(fa, 6) AS attribute, round(fr, 6) AS residual, round((fa - fr * ar) / sqrt((1 - fr * fr) * (1 - ar * ar)), 6) AS attribute_given_residual, round((fr - fa * ar) / sqrt((1 - fa * fa) * (1 - ar * ar)), 6) AS residual_given_attribute FROM c""",
    "attribute_share": f"WITH {_PARTS}, {_TOKEN_PARTS}, by_pos AS (SELECT pos, var_pop(x) AS x, var_pop(a) AS a, count(*) AS n FROM both_parts GROUP BY 1) SELECT max(n) AS n_tokens, round(sum(a) / sum(x), 6) AS share FROM by_pos",
    "instrument_features": f"WITH {_features_sql(SECTORS)} SELECT instrument_id, feature, round(value, 6) AS value FROM feats",
    "standard_features": f"""
WITH {_features_sql([])}, m AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS s FROM feats GROUP BY 1)
SELECT instrument_id, feature, round(CASE WHEN feature = 'is_144a' THEN value ELSE (value - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END END, 4) + 0.0 AS value FROM feats JOIN m USING (feature)""",
    "token_weights": "WITH t AS (SELECT token_id, (DATE '2010-03-01' - CAST(born_ts AS DATE)) / 365.25 AS age FROM token_map) SELECT token_id, round(2.0 * exp(-age / 4) * CASE WHEN age < 1 THEN 1.5 ELSE 1.0 END, 6) AS weight FROM t",
    "entropy_floor": f"WITH {_LOGGED} SELECT count(*) AS n, round(-avg(lp), 6) AS floor_nats, round(avg(ln(greatest(n, 1))), 6) AS uniform_nats FROM logged",
    "entropy_floor_by_size": f"WITH {_LOGGED} SELECT CAST(least(floor(log2(greatest(n, 1))), 12) AS BIGINT) AS stratum, count(*) AS n, round(-avg(lp), 6) AS floor_nats FROM logged GROUP BY 1",
    "excess_over_floor": f"""
WITH {_LOGGED}, ok AS (SELECT lp AS t, lp - 1.0 / n AS m FROM logged WHERE event_id % 10 <> 0)
SELECT count(*) AS n, round(-avg(m), 6) AS model_nats, round(-avg(t), 6) AS floor_nats, round(avg(t) - avg(m), 6) AS excess_nats, round((avg(t) - avg(m)) / ln(2), 6) AS excess_bits FROM ok""",
    "norm_frequency": f"""
WITH {_LOGGED}, c AS (SELECT token_id, count(*) AS n FROM latest GROUP BY 1 HAVING count(*) >= 3),
good AS (SELECT token_id, CAST(v AS DOUBLE[]) AS v FROM oracle_token_vectors WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x))) = 0),
s AS (SELECT token_id, avg(list_dot_product(v, v) / 128) AS s FROM good GROUP BY 1) SELECT count(*) AS n_tokens, round(corr(ln(n), s), 6) AS correlation FROM c JOIN s USING (token_id)""",
    "event_ids": "SELECT event_id, (user_id % 8) * 281474976710656 + event_id AS packed_id, user_id % 8 AS shard, event_id AS counter FROM events",
    "monthly_layout": "SELECT strftime(trade_date, '%Y-%m') AS trade_month, count(*) AS n_rows FROM rfq_lines GROUP BY 1",
    "layout_mismatches": "SELECT '' AS file, '' AS problem WHERE false",
    "layout_record": "SELECT strftime(trade_date, '%Y-%m') AS trade_month, count(*) AS n_rows, true AS no_file_empty, true AS no_file_twice, '1' AS schema_version FROM rfq_lines GROUP BY 1",
    "layout_tampered": """
WITH m AS (SELECT DISTINCT strftime(trade_date, '%Y-%m') AS trade_month FROM rfq_lines)
SELECT trade_month, 'sha256' AS problem FROM m WHERE trade_month = (SELECT min(trade_month) FROM m)
UNION ALL SELECT trade_month, 'size' FROM m WHERE trade_month = (SELECT max(trade_month) FROM m) AND trade_month <> (SELECT min(trade_month) FROM m) UNION ALL SELECT '0000-00', 'missing'""",
    "run_manifest": " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, count(*) AS n_rows FROM {t}" for t in RUN),
    "stream_gaps": "SELECT user_id, event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events",
    "stream_blocks": "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 64 AS block FROM events",
    "stream_windows": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
QUERIES = {
    f.__name__: f
    for f in (
        philox_words, philox_numbers, categorical_draws, bucket_draws, resampled_hours, log_partition, softmax_draws, best_offers, vector_norms, token_means, side_axis, gram_recovery, geometry_parts, attribute_share, axis_recovery, instrument_features, standard_features,
        token_weights, entropy_floor, entropy_floor_by_size, excess_over_floor, norm_frequency, event_ids, monthly_layout, layout_mismatches, layout_record, layout_tampered, run_manifest, stream_gaps, stream_blocks, stream_windows,
    )
}
