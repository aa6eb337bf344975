"""Choices among the candidates of a group: partition functions and draws, by aggregation alone."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_partition(df: DataFrame, group: str, logit: Column, allowed: Column) -> DataFrame:
    """``group, log_z, n_candidates, n_masked``: ln of the sum of exp(logit) over allowed rows, shifted by the greatest.

    A group with no allowed row has minus infinity. Null logits are no
    candidates and count as masked; a null group is a group.
    """
    ok = F.coalesce(allowed, F.lit(False)) & logit.isNotNull()
    rows = df.select(F.col(group), F.when(ok, logit.cast("double")).alias("l"))
    top = rows.groupBy(F.col(group).alias("_g")).agg(F.max("l").alias("_m"))
    shifted = rows.join(top, F.col(group).eqNullSafe(F.col("_g")))
    out = shifted.groupBy(group).agg(F.max("_m").alias("m"), F.sum(F.exp(F.col("l") - F.col("_m"))).alias("s"), F.count("l").alias("n_candidates"), F.count(F.when(F.col("l").isNull(), 1)).alias("n_masked"))
    return out.select(group, F.when(F.col("n_candidates") > 0, F.col("m") + F.ln("s")).otherwise(F.lit(float("-inf"))).alias("log_z"), "n_candidates", "n_masked")


def softmax_draw(df: DataFrame, group: str, candidate: str, logit: Column, allowed: Column, u: Column) -> DataFrame:
    """``group, chosen, logit``: one candidate per group with softmax probability.

    The greatest logit + Gumbel noise wins, so a draw is a plain maximum that
    each task can take over its own rows; ``u`` is a uniform number per row.
    Groups without an allowed candidate give no row; ties go to the larger id.
    """
    rows = df.where(F.coalesce(allowed, F.lit(False)) & logit.isNotNull()).select(F.col(group), (logit - F.ln(-F.ln(u))).alias("score"), F.col(candidate).alias("chosen"), logit.alias("logit"))
    return rows.groupBy(group).agg(F.max(F.struct("score", "chosen", "logit")).alias("x")).select(group, "x.chosen", "x.logit")


def best_two(df: DataFrame, group: str, value: str, slot: str) -> DataFrame:
    """``group, best_slot, best, second_slot, second, n``: the two smallest values, ties to the smaller slot; null values do not compete."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(group), F.struct(F.col(value).alias("v"), F.col(slot).alias("s")).alias("x"))
    first = rows.groupBy(F.col(group).alias("_g")).agg(F.min("x").alias("first"), F.count(F.lit(1)).alias("n"))
    second = rows.join(first, F.col(group) == F.col("_g")).groupBy(group, "first", "n").agg(F.min(F.when(F.col("x") > F.col("first"), F.col("x"))).alias("second"))
    return second.select(group, F.col("first.s").alias("best_slot"), F.col("first.v").alias("best"), F.col("second.s").alias("second_slot"), F.col("second.v").alias("second"), "n")
