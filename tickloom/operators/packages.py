"""Lines grouped into packages, and token pairs within short stretches of the tape."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.plans.ranking import rank_in_group
from tickloom.sources.layout import shard_of


def latest_lines(tape: DataFrame) -> DataFrame:
    """One row per ``event_id``: of several deliveries that with the latest outcome, then the smallest codes and client."""
    order = W.partitionBy("event_id").orderBy(F.desc("outcome_ts"), "enquiry_outcome", "our_result", F.asc_nulls_last("client_id"))
    return tape.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def sentences(lines: DataFrame, token: str = "token_id") -> DataFrame:
    """``package_id, client_id, trade_date, ts_first_us, tokens, n_clients``: a package's tokens in line order.

    Client and date are those of the first line by (time, line number). A null
    token keeps its place. A package is as large as its enquiry, so it is
    gathered in one row.
    """
    row = F.struct("ts_us", "line_no", "event_id", "client_id", "trade_date")
    by = lines.where("package_id IS NOT NULL").groupBy("package_id").agg(
        F.min(row).alias("first"), F.array_sort(F.collect_list(F.struct("line_no", "ts_us", "event_id", F.col(token).alias("token")))).alias("rows"), F.count_distinct("client_id").alias("n_clients")
    )
    return by.select("package_id", "first.client_id", "first.trade_date", F.col("first.ts_us").alias("ts_first_us"), F.expr("transform(rows, x -> x.token)").alias("tokens"), "n_clients")


def packages_by_first_lines(lines: DataFrame, item: str = "event_id", line_no: str = "line_no", width: int = 4096) -> DataFrame:
    """``item, package``: the last item up to each one, in the order of ids of one shard, whose line number is 0; null before the first.

    Ids are numbered in stretches of ``width``; a stretch's lines before its
    first package look at the stretches before it, of which there is one row each.
    """
    rows = lines.select(F.col(item).alias("item"), F.when(F.col(line_no) == 0, F.col(item)).alias("first")).where("item IS NOT NULL")
    keyed = rows.withColumn("shard", shard_of(F.col("item"))).withColumn("stretch", F.floor(F.col("item") / width))
    lasts = keyed.groupBy(F.col("shard").alias("sh"), F.col("stretch").alias("st")).agg(F.max("first").alias("last"))
    before = lasts.select("sh", "st", F.max("last").over(W.partitionBy("sh").orderBy("st").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
    inside = F.max("first").over(W.partitionBy("shard", "stretch").orderBy("item").rangeBetween(W.unboundedPreceding, 0))
    found = keyed.withColumn("inside", inside).join(before, (F.col("shard") == F.col("sh")) & (F.col("stretch") == F.col("st")))
    return found.select("item", F.coalesce("inside", "before").alias("package"))


def window_pair_counts(lines: DataFrame, token: str = "token_id", window: int = 64, slot_us: int = 60_000_000) -> DataFrame:
    """``token_a, token_b, same_client, n``: unordered token pairs within disjoint stretches of ``window`` lines of a day.

    Lines of a day are ordered by (time, event id); their positions come from
    counts per time slot, so a day is never gathered in one task. A stretch is
    at most ``window`` rows. Lines without date, time or token take no part; two
    unknown clients are not the same.
    """
    rows = lines.select("trade_date", "ts_us", "event_id", "client_id", F.col(token).alias("token")).where("trade_date IS NOT NULL AND ts_us IS NOT NULL AND token IS NOT NULL")
    placed = rank_in_group(rows, ["trade_date"], ["ts_us", "event_id"], F.floor(F.col("ts_us") / slot_us), salts=1)
    sorted_rows = F.array_sort(F.collect_list(F.struct("token", "client_id", "rank")))  # by token, so that every later one is not smaller
    keyed = placed.withColumn("stretch", F.floor(F.col("rank") / window))
    # By number: a stretch grows by window / 2 when its pairs come out, which joining partitions by their bytes does not see.
    spread = keyed.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trade_date", "stretch")
    stretches = spread.groupBy("trade_date", "stretch").agg(sorted_rows.alias("rows"))
    arrays = stretches.select(F.expr("transform(rows, x -> x.token)").alias("t"), F.expr("transform(rows, x -> x.client_id)").alias("c"))
    later = arrays.select(F.posexplode("t").alias("i", "token_a"), "t", "c").select("token_a", F.get("c", F.col("i")).alias("ca"), *(F.slice(x, F.col("i") + 2, F.lit(window)).alias(n) for x, n in (("t", "token_b"), ("c", "cb"))))
    pairs = later.select("token_a", "ca", F.inline(F.arrays_zip("token_b", "cb")))
    return pairs.groupBy("token_a", "token_b", F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("same_client")).agg(F.count(F.lit(1)).alias("n"))
