"""Overlapping windows of a token budget along an interleaved tape.

A window starts where the one before it started plus a stride of tokens, so the
starts form one long chain. Between two stretches of the tape the chain is
known by a single number below the stride: how far into the next stretch the
next start is due. Each stretch is therefore summed up by a table over these
numbers, the tables of a group are chained level by level, and every stretch
then lists its own starts.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.chains import _TABLE, begins, table_row
from tickloom.plans.ranking import rank_in_group
from tickloom.plans.storage import materialise

STRETCH = 32_768


def _own(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line starts in tokens from the stretch's begin (one more than lines, the last is the end), which lines are its own, and their order."""
    order = np.argsort(table["rank"].to_numpy(), kind="stable")
    return np.r_[0, np.cumsum(table["length"].to_numpy()[order])], table["ahead"].to_numpy(zero_copy_only=False)[order], order


def _tables(stride: int):
    def run(table: pa.Table) -> pa.Table:
        starts, ahead, _ = _own(table)
        n = int((~ahead).sum())
        end = starts[n]
        due, count = np.arange(stride), np.zeros(stride, np.int32)
        while (inside := np.flatnonzero(due < end)).size:
            line = np.searchsorted(starts[:n], due[inside], "right") - 1
            count[inside] += 1
            due[inside] = np.maximum(starts[line] + stride, starts[line + 1])
        return table_row(table["grp"][0].as_py(), table["stretch"][0].as_py(), due - end, count)

    return run


def _list(budget: int, stride: int, members: bool):
    """A stretch's windows, or else every window's items."""

    def run(table: pa.Table) -> pa.Table:
        starts, ahead, order = _own(table)
        first_rank = int(table["rank"].to_numpy().min())
        n = int((~ahead).sum())
        due, number = table["begin_due"][0].as_py(), table["begin_no"][0].as_py()
        found = []
        while due < starts[n]:
            line = int(np.searchsorted(starts[:n], due, "right")) - 1
            last = max(int(np.searchsorted(starts, starts[line] + budget, "right")) - 1, line + 1)
            found.append((number, first_rank + line, last - line, int(starts[last] - starts[line])))
            number, due = number + 1, max(starts[line] + stride, starts[line + 1])
        columns = [np.array(c, np.int64) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
        if members:
            size = columns[2]
            rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(columns[1], size)
            items = table["item"].to_numpy()[order][rank - first_rank]
            return pa.table([pa.array(np.full(len(rank), table["grp"][0].as_py(), np.int64)), pa.array(items), pa.array(np.repeat(columns[0], size)), pa.array(rank)], ["grp", "item", "seq_no", "rank"])
        return pa.table([pa.array([table["grp"][0].as_py()] * len(found), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], ["grp", "window_no", "first_rank", "n_lines", "n_tokens"])

    return run


def tape_windows(
    df: DataFrame, group: Column, time_us: str, item: str, length: Column, budget: int, stride: int, slot_us: int = 60_000_000, stretch: int = STRETCH, members: bool = False
) -> DataFrame:
    """``grp, window_no, first_rank, n_lines, n_tokens``: windows over a group's items in the order of (time, item).

    With ``members``: ``grp, item, seq_no, rank``, a row for each item of each window.

    A window takes whole items up to ``budget`` tokens, at least one; the next
    starts at the last item that begins at most ``stride`` tokens after this
    one's start, at least one item on. No item may be longer than ``stride``.
    Items without group, time or length take no part; no items give no rows.
    """
    if not 1 <= stride <= budget <= stretch:
        raise ValueError("stride <= budget <= stretch")
    rows = df.select(group.cast("long").alias("grp"), F.col(time_us).cast("long").alias("us"), F.col(item).cast("long").alias("item"), length.cast("long").alias("length")).where("grp IS NOT NULL AND us IS NOT NULL AND item IS NOT NULL AND length > 0")
    bounded = rows.withColumn("length", F.when(F.col("length") <= stride, F.col("length")).otherwise(F.raise_error(F.lit("an item is longer than the stride")).cast("long")))
    ranked = rank_in_group(bounded, ["grp"], ["us", "item"], F.floor(F.col("us") / slot_us), salts=1)
    placed = materialise(ranked.select("grp", F.floor(F.col("rank") / stretch).alias("stretch"), "rank", "length", "item"), "tape")
    ahead = placed.where((F.col("stretch") > 0) & (F.col("rank") % stretch < budget)).withColumn("stretch", F.col("stretch") - 1)  # what a window may reach into
    lines = placed.withColumn("ahead", F.lit(False)).unionByName(ahead.withColumn("ahead", F.lit(True)))
    tables = placed.withColumn("ahead", F.lit(False)).groupBy("grp", "stretch").applyInArrow(_tables(stride), _TABLE)
    known = lines.join(begins(tables).select(F.col("grp").alias("g"), F.col("stretch").alias("s"), F.col("state").alias("begin_due"), F.col("number").alias("begin_no")), (F.col("grp") == F.col("g")) & (F.col("stretch") == F.col("s")))
    kind = "grp long, item long, seq_no long, rank long" if members else "grp long, window_no long, first_rank long, n_lines long, n_tokens long"
    return known.select("grp", "stretch", "rank", "length", "item", "ahead", "begin_due", "begin_no").groupBy("grp", "stretch").applyInArrow(_list(budget, stride, members), kind)
