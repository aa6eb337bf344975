"""Time grids: clocks, zero-filled counts, runs of a state, and drift of a state vector."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.vectors import l1_distance


def session_clock(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """``events`` with ``session_us``: microseconds of trading time since the first session's open.

    ``calendar`` has ``trade_date, open_us, close_us``, one row per day. A time
    between sessions counts as the end of the one before, a time before the
    first as 0. The day is an equality, so the look-up is no range join; the
    calendar has a row per day.
    """
    day = F.floor(F.col("ts_us") / 86_400_000_000).cast("long")
    days = calendar.select(F.datediff("trade_date", F.lit("1970-01-01")).cast("long").alias("d"), "open_us", "close_us").where("open_us IS NOT NULL AND close_us IS NOT NULL")
    order = W.orderBy("d").rowsBetween(W.unboundedPreceding, -1)
    summed = days.withColumn("before", F.coalesce(F.sum(F.col("close_us") - F.col("open_us")).over(order), F.lit(0)))
    # A row for every day up to the next session, so that days without a session find the last one; days after the last session count as its day.
    day = F.least(day, days.agg(F.max("d")).scalar())
    spans = summed.withColumn("next_d", F.coalesce(F.lead("d").over(W.orderBy("d")), F.col("d") + 1)).withColumn("day", F.explode(F.sequence("d", F.col("next_d") - 1)))
    at = F.least(F.greatest(F.col("ts_us") - F.col("open_us"), F.lit(0)), F.col("close_us") - F.col("open_us"))
    return events.withColumn("_day", day).join(spans.select("day", "open_us", "close_us", "before"), F.col("_day") == F.col("day"), "left").select(
        *events.columns, F.coalesce(F.col("before") + at, F.lit(0)).alias("session_us")
    )


def grid_counts(lines: DataFrame, day: str, slot: Column, first: int, last: int) -> DataFrame:
    """``day, slot, n``: lines per slot of every day that has lines, and 0 for empty slots in [first, last].

    The frame only adds zeros: slots outside it that have lines come out too.
    """
    keyed = lines.select(F.col(day).alias("day"), slot.cast("long").alias("slot")).where("day IS NOT NULL AND slot IS NOT NULL")
    counts = keyed.groupBy("day", "slot").agg(F.count(F.lit(1)).alias("n"))
    frame = counts.select("day").distinct().select("day", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("slot"), F.lit(0).cast("long").alias("n"))
    return counts.unionByName(frame).groupBy("day", "slot").agg(F.sum("n").alias("n"))


def sojourns(rows: DataFrame, keys: list[str], order: list[str], time_us: str, state: str) -> DataFrame:
    """``keys, sojourn_no, state, t_start_us, t_end_us, n``: runs of one state; each ends where the next begins, the last is open.

    The keys bound what is ordered together: they include a period, such as the
    day. A null state is a state of its own.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    changed = rows.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).when(F.col(state).eqNullSafe(F.lag(state).over(w)), 0).otherwise(1))
    numbered = changed.withColumn("sojourn_no", (F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1).cast("long"))
    runs = numbered.groupBy(*keys, "sojourn_no", F.col(state).alias("state")).agg(F.min(time_us).alias("t_start_us"), F.count(F.lit(1)).alias("n"))
    return runs.select(*keys, "sojourn_no", "state", "t_start_us", F.lead("t_start_us").over(W.partitionBy(*keys).orderBy("sojourn_no")).alias("t_end_us"), "n")


def steps(grid: DataFrame, day: str, slot: str, vector: str) -> DataFrame:
    """``grid`` with ``step_l1``: the L1 distance to the vector one slot before, null at a day's first slot."""
    w = W.partitionBy(day).orderBy(slot)
    return grid.withColumn("step_l1", l1_distance(F.col(vector), F.lag(vector).over(w)))


def rolling_drift(stepped: DataFrame, day: str, slot: str, window: int) -> DataFrame:
    """``day, slot, drift``: sums of ``window`` consecutive steps within a day; only full windows."""
    w = W.partitionBy(day).orderBy(slot).rowsBetween(-(window - 1), 0)
    return stepped.where("step_l1 IS NOT NULL").select(day, slot, F.sum("step_l1").over(w).alias("drift"), F.count(F.lit(1)).over(w).alias("_n")).where(F.col("_n") == window).drop("_n")


def drift_summary(drift: DataFrame) -> DataFrame:
    """``mean, p99, greatest, n`` with the interpolated quantile; a grid has as many rows as time has slots."""
    return drift.agg(F.avg("drift").alias("mean"), F.percentile("drift", F.lit(0.99)).alias("p99"), F.max("drift").alias("greatest"), F.count(F.lit(1)).alias("n"))


def displacement(r0: Column, rho: Column, steps_: Column, d: int) -> tuple[Column, Column]:
    """(L2, L1) distance that a walk of radius r0 and one-step correlation rho is expected to move in so many steps."""
    l2 = r0 * F.sqrt(2 * (1 - F.pow(rho, steps_)))
    return l2, l2 * math.sqrt(2 * d / math.pi)


def longest_window(r0: Column, rho: Column, l2: Column) -> Column:
    """The most steps within which the expected L2 displacement stays at most ``l2``; null if it always does."""
    x = l2 * l2 / (2 * r0 * r0)
    return F.when(x < 1, F.floor(F.ln(1 - x) / F.ln(rho)).cast("long"))


def decayed_level(rows: DataFrame, key: str, day: Column, value: Column, phi: float) -> DataFrame:
    """``key, day, level``: the recursion level(t) = phi level(t-1) + value(t) over days, in closed form.

    Days are first summed per key, so that the sum of phi^(t-s) value(s) is a
    running sum of value(s) phi^-s over at most one row per day. s counts from
    the start of a stretch of days, short enough that phi^-s stays below 10^200;
    a stretch's level at its end goes on to later ones, one row per key and stretch.
    """
    daily = rows.select(F.col(key).alias("key"), F.datediff(day, F.lit("1970-01-01")).alias("t"), value.cast("double").alias("x")).where("key IS NOT NULL AND t IS NOT NULL").groupBy("key", "t").agg(F.sum("x").alias("x"))
    length = 100_000 if phi == 1 else max(1, min(100_000, int(200 * math.log(10) / abs(math.log(phi)))))
    since = F.col("t") - F.min("t").over(W.partitionBy("key"))
    placed = daily.withColumn("since", since).withColumn("stretch", F.floor(F.col("since") / length)).withColumn("s", (F.col("since") - F.col("stretch") * length).cast("double"))
    power = lambda n: F.pow(F.lit(phi), n)
    run = F.sum(F.col("x") * power(-F.col("s"))).over(W.partitionBy("key", "stretch").orderBy("t").rowsBetween(W.unboundedPreceding, 0))
    ends = placed.groupBy("key", "stretch").agg(F.sum(F.col("x") * power(length - F.col("s"))).alias("end"))
    earlier = F.collect_list(F.struct("stretch", "end")).over(W.partitionBy("key").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))
    carry = F.aggregate(earlier, F.lit(0.0), lambda a, e: a + e["end"] * power(((F.col("stretch") - e["stretch"] - 1) * length).cast("double")))
    carried = ends.select("key", "stretch", carry.alias("carry"))
    level = (F.col("run") + F.col("carry")) * power(F.col("s"))
    return placed.withColumn("run", run).join(carried, ["key", "stretch"]).select(F.col("key").alias(key), F.date_add(F.lit("1970-01-01").cast("date"), F.col("t")).alias("day"), level.alias("level"))
