"""States carried along a chain of stretches, without walking a long chain in one task.

A stretch is summed up by a table: for every state before it, the state after it
and how many marks it sets. Tables of neighbouring stretches combine into one
table, so a chain is summed up level by level and then its states are handed
down the same way; a task sees at most ``fan`` tables of one chain.
"""

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.storage import materialise

_TABLE = "grp long, stretch long, after array<int>, marks array<int>"
_BEGIN = "grp long, stretch long, state int, number long"


def table_row(grp: int, stretch: int, after: np.ndarray, marks: np.ndarray) -> pa.Table:
    lists = (pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (after, marks))
    return pa.table([pa.array([grp], pa.int64()), pa.array([stretch], pa.int64()), *lists], ["grp", "stretch", "after", "marks"])


def _steps(table: pa.Table) -> tuple[np.ndarray, Iterable[tuple[np.ndarray, np.ndarray]]]:
    order = np.argsort(table["stretch"].to_numpy())
    after, marks = (pc.list_flatten(table[c].combine_chunks()).to_numpy().reshape(len(order), -1)[order] for c in ("after", "marks"))
    return table["stretch"].to_numpy()[order], zip(after, marks)


def _combine(table: pa.Table) -> pa.Table:
    _, steps = _steps(table)
    state = marks = None
    for after, own in steps:
        state, marks = (after, own) if state is None else (after[state], marks + own[state])
    return table_row(table["grp"][0].as_py(), table["parent"][0].as_py(), state, marks)


def _walk(table: pa.Table) -> pa.Table:
    stretches, steps = _steps(table)
    state, number = table["state"][0].as_py(), table["number"][0].as_py()
    states, numbers = [], []
    for after, marks in steps:
        states.append(state)
        numbers.append(number)
        state, number = int(after[state]), number + int(marks[state])
    return pa.table([pa.array([table["grp"][0].as_py()] * len(states), pa.int64()), pa.array(stretches), pa.array(states, pa.int32()), pa.array(numbers, pa.int64())], ["grp", "stretch", "state", "number"])


def begins(tables: DataFrame, fan: int = 256) -> DataFrame:
    """``grp, stretch, state, number``: the state before each stretch and the marks set until then.

    ``tables`` has ``grp, stretch, after, marks``; a chain's stretches are 0, 1,
    2, ... and it begins in state 0.
    """
    tables = materialise(tables, "tables").withColumn("parent", F.floor(F.col("stretch") / fan))
    if tables.where("parent > 0").isEmpty():
        known = tables.withColumn("state", F.lit(0)).withColumn("number", F.lit(0).cast("long"))
    else:
        above = begins(tables.groupBy("grp", "parent").applyInArrow(_combine, _TABLE), fan)
        known = tables.join(above.select(F.col("grp").alias("_g"), F.col("stretch").alias("_s"), "state", "number"), (F.col("grp") == F.col("_g")) & (F.col("parent") == F.col("_s")))
    return known.select("grp", "parent", "stretch", "after", "marks", "state", "number").groupBy("grp", "parent").applyInArrow(_walk, _BEGIN)
