"""Checks and summary statistics of a tape."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dense_counts(dim: DataFrame, key: str, lines: DataFrame, column: str) -> DataFrame:
    """``key, n`` for every key of ``dim``, 0 where no line has it."""
    counts = lines.groupBy(F.col(column).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    return dim.select(key).distinct().join(counts, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def gini(counts: DataFrame, column: str = "n") -> DataFrame:
    """``n_active, gini`` of the positive values.

    Equal values are one row with their number, whose ranks are summed by
    arithmetic. Smaller values are counted per range of values and within it,
    so neither a common value nor the whole is sorted in one task; null, NaN
    and values that are not positive take no part.
    """
    active = counts.select(F.col(column).cast("double").alias("x")).where("x > 0 AND NOT isnan(x)")
    values = active.groupBy("x").agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.floor(F.log2("x") * 64))
    before = W.orderBy("r").rowsBetween(W.unboundedPreceding, -1)  # over one row per range, of which a double has some 130,000 at most
    ranges = values.groupBy(F.col("range").alias("r")).agg(F.sum("n").alias("in_range")).select("r", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("below"))
    smaller = F.coalesce(F.sum("n").over(W.partitionBy("range").orderBy("x").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = values.withColumn("smaller", smaller).join(ranges, F.col("range") == F.col("r"))
    n = F.col("n").cast("double")
    rank_sum = n * (F.col("below") + F.col("smaller")) + n * (n + 1) / 2
    sums = placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(n * F.col("x")).alias("s"), F.sum(rank_sum * F.col("x")).alias("rx"))
    return sums.select(F.col("n").alias("n_active"), F.when(F.col("n") > 0, (2 * F.col("rx") - (F.col("n") + 1) * F.col("s")) / (F.col("n") * F.col("s"))).alias("gini"))


def band_check(value: Column, low: float | None, high: float | None) -> Column:
    """PASS within the bounds that are given, else FAIL; a null value fails."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (value >= low)
    if high is not None:
        inside = inside & (value <= high)
    return F.when(inside, "PASS").otherwise("FAIL")


def shares(lines: DataFrame, checks: dict[str, tuple[Column, Column, float, float]]) -> DataFrame:
    """``check, value, low, high, status``: share of rows (of those in the base) that meet a condition, all in one pass."""
    sums = lines.agg(*(F.avg(F.when(base, meets.cast("double"))).alias(name) for name, (meets, base, _, _) in checks.items()))
    rows = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("value"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), band_check(F.col(n), lo, hi).alias("status")) for n, (_, _, lo, hi) in checks.items()))
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def mean_loss(rows: DataFrame, log_p: Column, candidates: Column) -> DataFrame:
    """``n, floor_nats, uniform_nats``: mean of -log p and of ln(candidates) over rows with a finite log p."""
    ready = rows.select(log_p.cast("double").alias("lp"), candidates.cast("double").alias("c")).where("lp IS NOT NULL AND NOT isnan(lp) AND abs(lp) < double('infinity')")
    return ready.agg(F.count(F.lit(1)).alias("n"), (-F.avg("lp")).alias("floor_nats"), F.avg(F.ln(F.greatest(F.coalesce("c", F.lit(1.0)), F.lit(1.0)))).alias("uniform_nats"))


def mean_loss_by_size(rows: DataFrame, log_p: Column, candidates: Column) -> DataFrame:
    """``stratum, n, floor_nats``: the same by the bit length of the number of candidates, at most 12."""
    size = F.greatest(F.coalesce(candidates.cast("long"), F.lit(1)), F.lit(1))
    stratum = F.least(F.length(F.bin(size)) - 1, F.lit(12)).cast("long")
    ready = rows.select(log_p.cast("double").alias("lp"), stratum.alias("stratum")).where("lp IS NOT NULL AND NOT isnan(lp) AND abs(lp) < double('infinity')")
    return ready.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), (-F.avg("lp")).alias("floor_nats"))


def excess_loss(model: DataFrame, truth: DataFrame, key: str, model_lp: str, truth_lp: str) -> DataFrame:
    """``n, model_nats, floor_nats, excess_nats, excess_bits`` over the model's rows whose key has a finite true log p."""
    joined = model.select(F.col(key).alias("k"), F.col(model_lp).alias("m")).join(truth.select(F.col(key).alias("k"), F.col(truth_lp).alias("t")), "k", "left")
    ready = joined.where("m IS NOT NULL AND t IS NOT NULL AND NOT isnan(m) AND NOT isnan(t) AND abs(m) < double('infinity') AND abs(t) < double('infinity')")
    sums = ready.agg(F.count(F.lit(1)).alias("n"), (-F.avg("m")).alias("model_nats"), (-F.avg("t")).alias("floor_nats"))
    excess = F.col("model_nats") - F.col("floor_nats")
    return sums.select("n", "model_nats", "floor_nats", excess.alias("excess_nats"), (excess / F.ln(F.lit(2.0))).alias("excess_bits"))
