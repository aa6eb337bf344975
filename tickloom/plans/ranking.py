"""Ranks within groups without gathering a group in one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 64


def rank_in_group(df: DataFrame, group: list[str], order: list[str], stratum: Column | None = None, salts: int | Column = SALTS) -> DataFrame:
    """``df`` with ``rank``: 0, 1, 2, ... in each group.

    A group is cut into its strata and those by a hash of ``order`` into
    ``salts`` parts; each part is numbered by itself and begins where the parts
    before it end. Ranks rise with the stratum, are otherwise arbitrary but
    repeatable, and rows equal in ``order`` may exchange theirs. Rows with a
    null group or stratum have a null rank. The table of parts has at most
    groups x strata x salts rows, where ``salts`` may be a column that is one
    value per group and grows with the group; plain equality joins it back, so that rows
    keep the partitioning of their numbering.
    """
    parts = df.withColumn("_stratum", F.lit(0) if stratum is None else stratum).withColumn("_part", F.pmod(F.xxhash64(*order), salts if isinstance(salts, Column) else F.lit(salts)))
    key = [*group, "_stratum", "_part"]
    sizes = parts.groupBy(*key).agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*group).orderBy("_stratum", "_part").rowsBetween(W.unboundedPreceding, -1)
    begins = sizes.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"))
    numbered = parts.withColumn("_row", F.row_number().over(W.partitionBy(*key).orderBy(*order)))
    same = [F.col(c) == F.col(f"_k{i}") for i, c in enumerate(key)]
    met = same[0]
    for s in same[1:]:
        met = met & s
    return numbered.join(begins, met, "left").select(*df.columns, (F.col("_begin") + F.col("_row") - 1).alias("rank"))


def running_total(df: DataFrame, order: list[str], stratum: Column, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over all rows before, in the order of ``order``.

    ``stratum`` rises with the order and cuts the whole into stretches; each is
    summed by itself and begins where those before it end. The table of
    stretches is the only one that is ordered in one task.
    """
    placed = df.withColumn("_stratum", stratum)
    before = W.orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    begins = placed.groupBy(F.col("_stratum").alias("_s")).agg(F.sum(value).alias("_whole")).select("_s", F.coalesce(F.sum("_whole").over(before), F.lit(0)).alias("_begin"))
    own = F.coalesce(F.sum(value).over(W.partitionBy("_stratum").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_own", own).join(begins, F.col("_stratum").eqNullSafe(F.col("_s"))).select(*df.columns, (F.col("_begin") + F.col("_own")).alias(out))
