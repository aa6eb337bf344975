"""Registered queries of the general problems 1, 4 and 5, with SQL that gives the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.epoch import micros, utc_month
from tickloom.operators.activity_sessions import earliest, sessions
from tickloom.operators.asof_versions import asof_versions
from tickloom.operators.heavy_keys import dominant_keys, totals_by_key
from tickloom.plans.storage import materialise
from tickloom.sources.tables import table

SESSION_GAP_US = 1_800_000_000


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return earliest(table(spark, root, "line_blocks"), "ev_id", "client_id", "ts_us")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Keys that hold at least 4 % of a month's items."""
    lines = _lines(spark, root).select(F.concat(F.lit("line_blocks|"), utc_month(F.col("ts_us"))).alias("grp"), F.col("entity").alias("key"))
    vectors = table(spark, root, "oracle_token_vectors").select(F.concat(F.lit("oracle_token_vectors|"), F.date_format("asof_date", "yyyy-MM")).alias("grp"), F.col("token_id").alias("key"))
    counts = materialise(totals_by_key(lines.unionByName(vectors), F.col("key"), F.col("grp")), "totals")
    part = F.split("grp", r"\|")
    return dominant_keys(counts).select(part[0].alias("src"), part[1].alias("trade_month"), "key_id")


def p1_client_totals(spark: SparkSession, root: str) -> DataFrame:
    """Every client's rows per month: rows, tokens, first and last time."""
    rows = table(spark, root, "line_blocks").where("ts_us > 0")
    out = totals_by_key(rows, F.col("client_id"), utc_month(F.col("ts_us")), {"tokens": ("sum", F.col("line_len")), "first_us": ("min", F.col("ts_us")), "last_us": ("max", F.col("ts_us"))})
    return out.select(F.col("grp").alias("trade_month"), F.col("key_id").alias("client_id"), F.col("n").alias("n_rows"), "tokens", "first_us", "last_us")


def p1_token_totals(spark: SparkSession, root: str) -> DataFrame:
    """Every token's vectors per month: rows, rows with a vector, first and last vector."""
    rows = table(spark, root, "oracle_token_vectors")
    has = F.col("v").isNotNull().cast("long")
    out = totals_by_key(rows, F.col("token_id"), F.date_format("asof_date", "yyyy-MM"), {"n_vectors": ("sum", has), "first_vec": ("min", F.col("vec_id")), "last_vec": ("max", F.col("vec_id"))})
    return out.select(F.col("grp").alias("trade_month"), F.col("key_id").alias("token_id"), F.col("n").alias("n_rows"), "n_vectors", "first_vec", "last_vec")


def _asof(spark: SparkSession, root: str) -> DataFrame:
    lines = table(spark, root, "rfq_lines").select("event_id", "client_id", "trade_date", micros(F.col("ts")).alias("ts_us"))
    mandates = table(spark, root, "client_mandates").select("mandate_id", "client_id", "effective_from", "effective_to", micros(F.col("recorded_ts")).alias("known_us"))
    return asof_versions(
        lines, mandates, event_id="event_id", entity="client_id", day="trade_date", ts_us="ts_us", version_id="mandate_id", effective_from="effective_from", effective_to="effective_to", known_us="known_us"
    )


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Each line's mandate version in force and already recorded."""
    return _asof(spark, root).where("version_id IS NOT NULL").select("event_id", F.col("version_id").alias("mandate_id")).distinct()


def p4_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Per trade date: delivered lines with a client, and those with a version known at their time."""
    rows = _asof(spark, root).where("entity IS NOT NULL")
    return rows.groupBy(F.col("day").alias("trade_date")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("version_id").alias("n_with_version"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Each client's sessions."""
    out = sessions(_lines(spark, root), "entity", "ts_us", SESSION_GAP_US)
    return out.select(F.col("entity").alias("client_id"), "start_us", "end_us", F.col("n").alias("n_lines"))


def p5_client_summary(spark: SparkSession, root: str) -> DataFrame:
    """Per client: sessions, lines, longest and total duration."""
    out = sessions(_lines(spark, root), "entity", "ts_us", SESSION_GAP_US)
    return out.groupBy(F.col("entity").alias("client_id")).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_lines"), F.max("duration_us").alias("longest_us"), F.sum("duration_us").alias("total_us")
    )


_FIRST = "SELECT ev_id, min(client_id) AS client_id, min(ts_us) AS ts_us FROM line_blocks WHERE client_id IS NOT NULL AND ts_us > 0 GROUP BY ev_id"
_MONTH = "strftime(make_timestamp({}), '%Y-%m')"
_SESSIONS = f"""
first AS ({_FIRST}),
flagged AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= {SESSION_GAP_US} THEN 0 ELSE 1 END AS begins FROM first WINDOW w AS (PARTITION BY client_id ORDER BY ts_us, ev_id)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY client_id ORDER BY ts_us, ev_id ROWS UNBOUNDED PRECEDING) AS s FROM flagged),
sess AS (SELECT client_id, min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS n_lines FROM numbered GROUP BY client_id, s)"""
_KNOWN = """
SELECT l.event_id, l.trade_date, l.ts, l.client_id, (
    SELECT arg_max(m.mandate_id, row(m.effective_from, m.recorded_ts, m.mandate_id)) FROM client_mandates m
    WHERE m.client_id = l.client_id AND m.effective_from <= l.trade_date AND (m.effective_to IS NULL OR l.trade_date < m.effective_to) AND m.recorded_ts <= l.ts
) AS mandate_id FROM rfq_lines l WHERE l.client_id IS NOT NULL"""

SQL = {
    "p1_found": f"""
WITH first AS ({_FIRST}),
items AS (
    SELECT 'line_blocks' AS src, {_MONTH.format("ts_us")} AS trade_month, client_id AS key_id FROM first
    UNION ALL SELECT 'oracle_token_vectors', strftime(asof_date, '%Y-%m'), token_id FROM oracle_token_vectors WHERE token_id IS NOT NULL
),
counts AS (SELECT src, trade_month, key_id, count(*) AS n FROM items GROUP BY ALL),
shares AS (SELECT *, sum(n) OVER (PARTITION BY src, trade_month) AS whole FROM counts)
SELECT src, trade_month, key_id FROM shares WHERE 25 * n >= whole AND n >= 10""",
    "p1_client_totals": f"""
SELECT {_MONTH.format("ts_us")} AS trade_month, client_id, count(*) AS n_rows, CAST(sum(line_len) AS BIGINT) AS tokens, min(ts_us) AS first_us, max(ts_us) AS last_us
FROM line_blocks WHERE client_id IS NOT NULL AND ts_us > 0 GROUP BY 1, 2""",
    "p1_token_totals": """
SELECT strftime(asof_date, '%Y-%m') AS trade_month, token_id, count(*) AS n_rows, count(v) AS n_vectors, min(vec_id) AS first_vec, max(vec_id) AS last_vec
FROM oracle_token_vectors WHERE token_id IS NOT NULL GROUP BY 1, 2""",
    "p4_found": f"SELECT DISTINCT event_id, mandate_id FROM ({_KNOWN}) WHERE mandate_id IS NOT NULL",
    "p4_coverage": f"SELECT trade_date, count(*) AS n_rows, count(mandate_id) AS n_with_version FROM ({_KNOWN}) GROUP BY trade_date",
    "p5_found": f"WITH {_SESSIONS} SELECT * FROM sess",
    "p5_client_summary": f"""
WITH {_SESSIONS}
SELECT client_id, count(*) AS n_sessions, CAST(sum(n_lines) AS BIGINT) AS n_lines, max(end_us - start_us) AS longest_us, CAST(sum(end_us - start_us) AS BIGINT) AS total_us FROM sess GROUP BY client_id""",
}
QUERIES = {f.__name__: f for f in (p1_found, p1_client_totals, p1_token_totals, p4_found, p4_coverage, p5_found, p5_client_summary)}
