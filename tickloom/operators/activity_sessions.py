"""Sessions by inactivity gaps, from occupancy bitmaps.

The time axis is cut into cells a little shorter than 1/16 of the gap and the
cells into words of 48 bits. A word's bitmap says in which cells an entity was
active; closing it (dilation, then erosion, both by doubling shifts) fills the
holes that are certainly shorter than the gap, and its runs are pieces of
sessions. Exact first and last times of the runs' end cells then trim the
endpoints and decide which neighbouring runs belong together, so results are
exact to the microsecond.

An entity's rows are reduced to its occupied cells before any shuffle by
entity: what one task holds of an entity is bounded by the length of time, not
by the entity's rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS_PER_GAP = 16
WORD_CELLS = 48  # with the 15 cells of dilation it stays below the sign bit


def _grid(gap_us: int) -> tuple[int, int]:
    """(cell width, reach): occupied cells at most ``reach`` apart surely hold times at most ``gap_us`` apart."""
    if gap_us < 1:
        raise ValueError("the gap is at least one microsecond")
    width = max(1, (gap_us + 1) // (CELLS_PER_GAP + 1))
    return width, min(CELLS_PER_GAP, (gap_us + 1) // width - 1)


def closed(bits: Column, reach: int) -> Column:
    """Morphological closing: holes between set bits at most ``reach`` apart are filled."""
    steps, reached = [], 1
    while reached < reach:
        steps.append(min(reached, reach - reached))
        reached += steps[-1]
    for s in steps:
        bits = bits.bitwiseOR(F.shiftleft(bits, s))
    for s in steps:
        bits = bits.bitwiseAND(F.shiftrightunsigned(bits, s))
    return bits


def earliest(df: DataFrame, item: str, entity: str, ts_us: str) -> DataFrame:
    """One row per item, at its earliest usable time: ``item, entity, ts_us``.

    Unusable are rows without an item or entity and times that are null or not
    after the epoch. Should an item's usable rows name several entities, the
    smallest counts.
    """
    usable = df.select(F.col(item).alias("item"), F.col(entity).alias("entity"), F.col(ts_us).alias("ts_us")).where("item IS NOT NULL AND entity IS NOT NULL AND ts_us > 0")
    return usable.groupBy("item").agg(F.min("entity").alias("entity"), F.min("ts_us").alias("ts_us"))


def sessions(events: DataFrame, entity: str, ts_us: str, gap_us: int) -> DataFrame:
    """Sessions of each entity: ``entity, start_us, end_us, duration_us, n``.

    Two neighbouring events of an entity share a session if they are at most
    ``gap_us`` apart. Rows with a null entity or time take no part; events at
    the same time count each; no rows give no sessions. Other columns are not
    read.
    """
    width, reach = _grid(gap_us)
    cells = (
        events.select(F.col(entity).alias("entity"), F.col(ts_us).cast("long").alias("us"))
        .where("entity IS NOT NULL AND us IS NOT NULL")
        .withColumn("cell", F.expr(f"(us - pmod(us, {width}L)) DIV {width}L"))
        .groupBy("entity", "cell")
        .agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("lo"), F.max("us").alias("hi"))
        .withColumn("pos", F.expr(f"CAST(pmod(cell, {WORD_CELLS}L) AS INT)"))
        .withColumn("word", F.expr(f"(cell - pos) DIV {WORD_CELLS}L"))
    )
    words = cells.groupBy("entity", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, pos)")).alias("bits"), F.collect_list(F.struct("pos", "n", "lo", "hi")).alias("cells")
    )
    runs = (
        words.withColumn("bits", closed(F.col("bits"), reach))
        .withColumn("starts", F.expr("bits & ~shiftleft(bits, 1)"))
        .select("entity", "word", "starts", F.inline("cells"))
        .withColumn("run", F.expr("bit_count(starts & (shiftleft(2L, pos) - 1))"))
        .groupBy("entity", "word", "run")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    order = W.partitionBy("entity").orderBy("lo")
    joined = runs.withColumn("idle", F.col("lo") - F.lag("hi").over(order)).withColumn(
        "session", F.sum(F.when(F.col("idle") <= gap_us, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    )
    return (
        joined.groupBy("entity", "session")
        .agg(F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.sum("n").alias("n"))
        .select("entity", "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n")
    )
