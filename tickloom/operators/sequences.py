"""Lines cut into sequences of bounded length, and arrays made ready for training.

Greedy cutting depends only on how full the current sequence is, which is one
of ``budget + 1`` states. So a stretch of lines is summed up by a table from the
state before it to the state after it and the cuts made; the tables of a long
group are chained level by level, and then every stretch is cut on its own.
Cuts are found by jumps from one sequence's start to the next, for all states or
groups at once.
"""

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.counter_rng import philox, uniform
from tickloom.operators.dictionary import BOS, EOS
from tickloom.plans.chains import _TABLE, begins, table_row
from tickloom.plans.ranking import rank_in_group
from tickloom.plans.storage import materialise

STRETCH = 16_384


def _next_start(filled: np.ndarray, budget: int) -> np.ndarray:
    """For a sequence that starts at each line, the line at which the next one starts; ``filled`` has the tokens before each line and the total."""
    n = len(filled) - 1
    return np.maximum(np.searchsorted(filled, filled[:n] + budget, "right") - 1, np.arange(n) + 1)


def _tables(budget: int):
    def run(table: pa.Table) -> pa.Table:
        length = table["length"].to_numpy()[np.argsort(table["rank"].to_numpy(), kind="stable")].astype(np.int64)
        filled = np.r_[0, np.cumsum(length)]
        n, following = len(length), _next_start(filled, budget)
        state = np.arange(budget + 1)
        at = np.where(state > 0, np.searchsorted(filled, budget - state, "right") - 1, 0)  # the first line that does not fit
        marks, start = ((state > 0) & (at < n)).astype(np.int64), np.where((state > 0) & (at == n), -1, at)
        todo = np.flatnonzero(start >= 0)
        while len(todo := todo[following[start[todo]] < n]):
            start[todo] = following[start[todo]]
            marks[todo] += 1
        after = np.where(start < 0, state + filled[n], filled[n] - filled[np.maximum(start, 0)])
        return table_row(table["grp"][0].as_py(), table["stretch"][0].as_py(), np.minimum(after, budget), marks)

    return run


def _cut(budget: int):
    """Rows sorted by (grp, stretch, rank), with the stretch's begin, to sequence numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fill, number = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            group, stretch, length, begin_fill, begin_no = (batch.column(i).to_numpy().astype(np.int64) for i in range(5))
            first = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (stretch[1:] != stretch[:-1])])
            end = np.r_[first[1:], len(group)]
            held, numbers = begin_fill[first], begin_no[first]
            if last == (group[0], stretch[0]):
                held[0], numbers[0] = fill, number
            filled = np.r_[0, np.cumsum(length)]
            following = _next_start(filled, budget)
            # Where each stretch's first new sequence starts: at its first line if nothing is held, else at the first that does not fit.
            start = np.where(held > 0, np.searchsorted(filled, filled[first] + budget - held, "right") - 1, first)
            opens = np.zeros(len(group) + 1, np.int64)
            whole = start >= end
            opens[start[~whole & (held > 0)]] += 1
            current = np.where(whole, -1, start)
            todo = np.flatnonzero(~whole)
            while len(todo := todo[following[current[todo]] < end[todo]]):
                current[todo] = following[current[todo]]
                opens[current[todo]] += 1
            opened = np.cumsum(opens)[:-1]
            of = np.repeat(np.arange(len(first)), end - first)
            before = np.r_[0, opened][first]
            seq_no = numbers[of] + opened - before[of]
            last, number = (group[-1], stretch[-1]), int(seq_no[-1])
            fill = min(budget, int(held[-1] + filled[-1] - filled[first[-1]] if current[-1] < 0 else filled[-1] - filled[current[-1]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array(seq_no), batch.column(6)], ["grp", "item", "seq_no", "rank"])

    return run


def greedy_sequences(df: DataFrame, group: str, time_us: str, item: str, length: Column, budget: int, slot: Column | None = None, stretch: int = STRETCH) -> DataFrame:
    """``grp, item, seq_no, rank``: a group's items in the order of (time, item), in runs of at most ``budget``.

    Items are atomic: one longer than the budget stands alone. Items without
    group, time or length take no part. ``slot`` cuts time into stretches for
    numbering and rises with it; by default it is the day.
    """
    rows = df.select(F.col(group).cast("long").alias("grp"), F.col(time_us).cast("long").alias("us"), F.col(item).cast("long").alias("item"), length.cast("int").alias("length")).where(
        "grp IS NOT NULL AND us IS NOT NULL AND item IS NOT NULL AND length > 0"
    )
    ranked = rank_in_group(rows, ["grp"], ["us", "item"], F.floor(F.col("us") / 86_400_000_000) if slot is None else slot, salts=1)
    placed = materialise(ranked.select("grp", F.floor(F.col("rank") / stretch).alias("stretch"), "rank", "item", "length"), "placed")
    long_groups = placed.where("stretch > 0").select("grp").distinct()
    tables = placed.join(long_groups, "grp", "left_semi").groupBy("grp", "stretch").applyInArrow(_tables(budget), _TABLE)
    known = placed.join(begins(tables).select(F.col("grp").alias("g"), F.col("stretch").alias("s"), F.col("state").alias("begin_fill"), F.col("number").alias("begin_no")), (F.col("grp") == F.col("g")) & (F.col("stretch") == F.col("s")), "left")
    ready = known.select("grp", "stretch", "length", F.coalesce("begin_fill", F.lit(0)).alias("begin_fill"), F.coalesce("begin_no", F.lit(0)).cast("long").alias("begin_no"), "item", "rank")
    return ready.repartition("grp", "stretch").sortWithinPartitions("grp", "stretch", "rank").mapInArrow(_cut(budget), "grp long, item long, seq_no long, rank long")


def packed(items: DataFrame, tokens: DataFrame, item: str = "event_id", anchor: int = 3) -> DataFrame:
    """``grp, seq_no, n_lines, tokens, family, event_ids``: each run's lines between begin and end marks; a run is at most the budget.

    ``tokens`` has the lines' ``tokens`` and ``families``. ``event_ids`` has a
    line's id at its anchor and 0 elsewhere; the marks are of family 0.
    """
    rows = items.join(tokens.select(F.col(item).alias("item"), F.col("tokens").alias("t"), F.col("families").alias("f")), "item")
    by = rows.groupBy("grp", "seq_no").agg(F.array_sort(F.collect_list(F.struct("rank", "t", "f", "item"))).alias("rows"))
    marked = lambda first, each, last: F.concat(F.array(F.lit(first).cast("long")), F.flatten(F.transform("rows", each)), F.array(F.lit(last).cast("long")))
    long = lambda x: x.cast("array<long>")
    ids = lambda x: F.transform(x["f"], lambda f: F.when(f == anchor, x["item"]).otherwise(0).cast("long"))
    return by.select(
        "grp", "seq_no", F.size("rows").cast("long").alias("n_lines"), marked(BOS, lambda x: long(x["t"]), EOS).alias("tokens"), marked(0, lambda x: long(x["f"]), 0).alias("family"), marked(0, ids, 0).alias("event_ids")
    )


def fixed_context(tokens: Column, context: int, pad: int = 0) -> tuple[Column, Column]:
    """(inputs, labels) of exactly ``context`` tokens: cut or padded; padding has the label -100. Null for null."""
    kept = F.slice(tokens, 1, context)
    missing = F.greatest(F.lit(context) - F.size(kept), F.lit(0))
    kind = "array<long>"
    inputs = F.concat(kept.cast(kind), F.array_repeat(F.lit(pad).cast("long"), missing))
    labels = F.concat(kept.cast(kind), F.array_repeat(F.lit(-100).cast("long"), missing))
    return F.when(tokens.isNotNull(), inputs), F.when(tokens.isNotNull(), labels)


def anchor_positions(family: Column, anchor: int = 3) -> Column:
    """0-based positions whose next token is an anchor: where a model predicts one. Null for null."""
    found = F.filter(F.sequence(F.lit(0), F.greatest(F.size(family) - 2, F.lit(0))), lambda i: F.get(family, i + 1) == anchor)
    return F.when(family.isNotNull(), found)


def mixture_plan(sequences: DataFrame, seq_id: str, is_tape: Column, tape_share: float, key: tuple[int, int]) -> DataFrame:
    """``position, is_tape, seq_id``: a training order in which about ``tape_share`` of the positions hold a tape sequence.

    There are n + floor(n share / (1 - share)) positions for n other sequences.
    Each position draws by its own counter whether it holds a tape sequence and
    which; the others take the other sequences in turn. Without tape sequences
    all positions take those; without others there are no positions.
    """
    spark = sequences.sparkSession
    rows = sequences.select(F.col(seq_id).alias("seq_id"), F.coalesce(is_tape, F.lit(False)).alias("is_tape")).where("seq_id IS NOT NULL").distinct()
    ranked = rank_in_group(rows, ["is_tape"], ["seq_id"], F.floor(F.col("seq_id") / 4096), salts=1)
    counts = {r["is_tape"]: r["count"] for r in rows.groupBy("is_tape").count().collect()}
    n, n_tape = counts.get(False, 0), counts.get(True, 0)
    words = philox(F.col("id"), 3, key)
    drawn = spark.range(n + int(n * tape_share / (1 - tape_share))).select(F.col("id").alias("position"), (F.lit(n_tape > 0) & (uniform(words[0]) < tape_share)).alias("is_tape"), uniform(words[1]).alias("u"))
    index = F.when(F.col("is_tape"), F.floor(F.col("u") * n_tape)).otherwise(F.col("position") % max(n, 1)).cast("long")
    return drawn.withColumn("rank", index).join(ranked, ["is_tape", "rank"]).select("position", "is_tape", "seq_id")
