"""Filling containers of one capacity with items, shortest pack first over the histogram of lengths.

Only the histogram, which has at most as many rows as the capacity, goes to the
driver. Lengths are placed longest first, each into the packs with the most
room; packs with equal content are one pattern with a count, kept as a range of
pack numbers, and a placement splits off as much of a range as it needs. The
resulting table of placements says which ranks of each length go to which
packs; items get a rank within their length without being gathered and look
their pack up.
"""

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.ranking import rank_in_group

#: Parts of one length that one task ranks, about.
PART_ROWS = 200_000
Placement = tuple[int, int, int, int, int]


def placements(histogram: dict[int, int], capacity: int) -> list[Placement]:
    """(length, first rank, end rank, first pack, offset): these ranks of a length go to consecutive packs at an offset."""
    out: list[Placement] = []
    open_: list[tuple[int, int, int]] = []  # (-room, first pack, end pack): packs with equal room
    packs = 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        filled = []
        while left:
            if open_ and -open_[0][0] >= length:
                room, first, end = heapq.heappop(open_)
                room = -room
            else:
                opened = -(-left // (capacity // length))  # no more than this length itself needs
                room, first, end = capacity, packs, packs + opened
                packs += opened
            used = min(left, end - first)
            out.append((length, rank, rank + used, first, capacity - room))
            if used < end - first:
                heapq.heappush(open_, (-room, first + used, end))
            filled.append((room - length, first, first + used))
            rank, left = rank + used, left - used
            if not (open_ and -open_[0][0] >= length):
                # Packs that took one item of this length may take another.
                for room, first, end in filled:
                    if room:
                        heapq.heappush(open_, (-room, first, end))
                filled = []
        for room, first, end in filled:
            if room:
                heapq.heappush(open_, (-room, first, end))
    return out


def pack(df: DataFrame, item: str, length: str, capacity: int) -> DataFrame:
    """``item, part_no, part_start, n_tokens, pack_id, pack_offset``: one row per item, or per part of an oversized one.

    An item longer than ``capacity`` is cut into parts of ``capacity`` and a
    rest; no other is divided. A null or zero length takes no room: such an item
    comes out with null ``pack_id`` and ``pack_offset``. Repeated items are
    packed as often as they occur. No items give no rows. Other columns are
    not read.
    """
    if capacity < 1:
        raise ValueError("the capacity is positive")
    spark = df.sparkSession
    items = df.select(F.col(item).alias("item"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("size"))
    parts = (
        items.where("size > 0")
        .withColumn("part_no", F.explode(F.expr(f"sequence(0, CAST((size - 1) DIV {capacity} AS INT))")))
        .select("item", "part_no", (F.col("part_no").cast("long") * capacity).alias("part_start"), F.expr(f"least(CAST({capacity} AS BIGINT), size - part_no * CAST({capacity} AS BIGINT))").alias("n_tokens"))
    )
    histogram = {r["n_tokens"]: r["count"] for r in parts.groupBy("n_tokens").count().collect()}  # at most `capacity` rows
    rows = placements(histogram, capacity)
    places = spark.createDataFrame(rows, "length long, first_rank long, end_rank long, first_pack long, pack_offset long")
    # At most `capacity` rows.
    salts = spark.createDataFrame([(n, -(-count // PART_ROWS)) for n, count in histogram.items()], "n_tokens long, salts int")
    ranked = rank_in_group(parts.join(F.broadcast(salts), "n_tokens"), ["n_tokens"], ["item", "part_no"], salts=F.col("salts"))
    # The placements grow with the capacity, not with the items.
    placed = ranked.join(F.broadcast(places), (F.col("n_tokens") == F.col("length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    packed = placed.select("item", "part_no", "part_start", "n_tokens", (F.col("first_pack") + F.col("rank") - F.col("first_rank")).alias("pack_id"), "pack_offset")
    empty = items.where("size <= 0").select("item", F.lit(0).alias("part_no"), F.lit(0).cast("long").alias("part_start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("long").alias("pack_id"), F.lit(None).cast("long").alias("pack_offset"))
    return packed.unionByName(empty)
