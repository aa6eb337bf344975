"""The previous time within a group, without gathering a group in one task."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def previous_time(df: DataFrame, group: str, time_us: str, tie: str, chunk_us: int = DAY_US) -> DataFrame:
    """``df`` with ``previous_us``: the time of the row before in its group by (time, tie); null for the first.

    Rows are compared within stretches of ``chunk_us``; a stretch's first row
    looks up the last time of the stretch before, from a table with one row per
    group and stretch. Rows with a null group or time have no previous row.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(time_us) / chunk_us))
    lasts = chunked.where(F.col(group).isNotNull() & F.col(time_us).isNotNull()).groupBy(F.col(group).alias("_g"), F.col("_chunk").alias("_c")).agg(F.max(time_us).alias("_last"))
    before = lasts.select("_g", "_c", F.lag("_last").over(W.partitionBy("_g").orderBy("_c")).alias("_before"))
    inside = F.lag(time_us).over(W.partitionBy(group, "_chunk").orderBy(time_us, tie))
    keyed = chunked.where(F.col(group).isNotNull() & F.col(time_us).isNotNull()).withColumn("_inside", inside)
    found = keyed.join(before, (F.col(group) == F.col("_g")) & (F.col("_chunk") == F.col("_c"))).select(*df.columns, F.coalesce("_inside", "_before").alias("previous_us"))
    rest = df.where(F.col(group).isNull() | F.col(time_us).isNull()).withColumn("previous_us", F.lit(None).cast("long"))
    return found.unionByName(rest)
