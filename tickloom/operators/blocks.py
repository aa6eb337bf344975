"""Lines of a tape as short blocks of typed tokens."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.dictionary import LEG, SEP, Ranges, encode
from tickloom.plans.neighbours_in_time import previous_time

# Bucket edges and families of a block's positions.
SIZE_EDGES = (2.5e5, 5e5, 1e6, 2e6, 5e6, 1e7, 2.5e7)
DEALER_EDGES = (1, 2, 3, 4, 5, 7, 10)
GAP_BINS, GAP_LEAST_S, GAP_MOST_S = 24, 1.0, 30.0 * 86400.0
FAMILIES = ("SPECIAL", "TDLT", "CLI", "TOK", "SZ", "NDLR", "OUT")


def edge_bucket(value: Column, edges: tuple[float, ...]) -> Column:
    """How many edges are at most the value; null for null."""
    out = F.lit(0).cast("long")
    for e in edges:
        out = out + (value >= F.lit(float(e))).cast("long")
    return out


def gap_bucket(seconds: Column) -> Column:
    """0 for no gap or one that is not positive, else 1 to 24 on a log scale from a second to 30 days."""
    held = F.least(F.greatest(seconds, F.lit(GAP_LEAST_S)), F.lit(GAP_MOST_S))
    part = F.ln(held) / F.lit(math.log(GAP_MOST_S / GAP_LEAST_S))
    return F.when(seconds > 0, F.least(F.floor(part * F.lit(GAP_BINS - 1e-9)) + 1, F.lit(GAP_BINS))).otherwise(0).cast("long")


def outcome_code(outcome: Column, result: Column) -> Column:
    return F.least(F.greatest(outcome.cast("long"), F.lit(0)), F.lit(3)) * 6 + F.least(F.greatest(result.cast("long"), F.lit(0)), F.lit(5))


def with_gaps(lines: DataFrame) -> DataFrame:
    """First legs (``line_no`` 0) with ``gap_s``, the seconds since their client's previous first leg."""
    first = previous_time(lines.where("line_no = 0"), "client_id", "ts_us", "event_id")
    return first.withColumn("gap_s", (F.col("ts_us") - F.col("previous_us")) / 1e6).drop("previous_us")


def blocks(lines: DataFrame, clients: DataFrame, tokens: DataFrame, r: Ranges) -> DataFrame:
    """``event_id, client_id, ts_us, tokens, families``: 7 tokens for a first leg, 3 for a later one.

    ``clients`` and ``tokens`` are tables of codes (``sorted_codes``). A line
    without a client, and one whose token is unknown, gets the unknown id; null
    sizes count as the smallest bucket.
    """
    first = F.col("line_no") == 0
    own = ["event_id", "client_id", "ts_us", "line_no", "token_id", "qty_par", "n_dealers", "enquiry_outcome", "our_result"]
    rows = with_gaps(lines.select(*own)).unionByName(lines.select(*own).where("line_no <> 0").withColumn("gap_s", F.lit(None).cast("double")))
    coded = encode(encode(rows, "client_id", clients, "cli"), "token_id", tokens, "tok")
    size = r.encode("SZ", F.coalesce(edge_bucket(F.col("qty_par"), SIZE_EDGES), F.lit(0)))
    dealers = r.encode("NDLR", F.coalesce(edge_bucket(F.col("n_dealers"), DEALER_EDGES), F.lit(0)))
    outcome = r.encode("OUT", F.coalesce(outcome_code(F.col("enquiry_outcome"), F.col("our_result")), F.lit(0)))
    whole = F.array(F.lit(SEP).cast("long"), r.encode("TDLT", gap_bucket(F.col("gap_s"))), F.col("cli"), F.col("tok"), size, dealers, outcome)
    part = F.array(F.lit(LEG).cast("long"), F.col("tok"), size)
    return coded.select(
        "event_id", "client_id", "ts_us", F.when(first, whole).otherwise(part).alias("tokens"),
        F.when(first, F.array(*(F.lit(i) for i in range(7)))).otherwise(F.array(F.lit(0), F.lit(3), F.lit(4))).alias("families"),
    )
