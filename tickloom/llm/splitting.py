"""Cutting long token sequences into overlapping pieces at package or line starts.

Two plans are offered. ``greedy`` fills each piece as far as a boundary allows;
``bisection`` cuts at the strongest boundary near the middle and recurses on
the parts still too long, which gives pieces of even size. A sequence is one
row, and rows are cut independently where they were read: no token is shuffled.
"""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKAGE, LINE, LAST_SPECIAL = 3, 4, 2
Pieces = list[tuple[int, int]]


def _last(starts: np.ndarray, at_most: int) -> int:
    """The last start not after ``at_most``, else -1."""
    i = int(np.searchsorted(starts, at_most, "right"))
    return int(starts[i - 1]) if i else -1


def _overlapped(starts: np.ndarray, end: int, begin: int, overlap: int) -> int:
    """The first start after ``begin`` that is at most ``overlap`` before ``end``, else ``end``."""
    i = int(np.searchsorted(starts, max(begin + 1, end - overlap)))
    return min(int(starts[i]), end) if i < len(starts) else end


def greedy(packages: np.ndarray, lines: np.ndarray, begin: int, stop: int, limit: int, overlap: int) -> Pieces:
    """Pieces that end at the last package start within the limit, else at the last line start, else at the limit.

    A package start counts only if it is beyond the previous piece's end. The
    next piece begins at the earliest line start at most ``overlap`` tokens
    before the end of this one.
    """
    pieces, reached = [], begin
    while stop - begin > limit:
        end = _last(packages, begin + limit)
        if end <= reached:
            end = _last(lines, begin + limit)
        if end <= reached:
            end = begin + limit
        pieces.append((begin, end))
        begin, reached = _overlapped(lines, end, begin, overlap), end
    return [*pieces, (begin, stop)]


def _cut(packages: np.ndarray, lines: np.ndarray, begin: int, stop: int) -> int:
    """The package start nearest the midpoint in the middle half, else the line start nearest it, else the midpoint."""
    middle, quarter = (begin + stop) // 2, (stop - begin) // 4
    for starts, low, high in ((packages, middle - quarter, middle + quarter), (lines, begin + 1, stop - 1)):
        inside = starts[np.searchsorted(starts, max(low, begin + 1)) : np.searchsorted(starts, min(high, stop - 1), "right")]
        if len(inside):
            return int(inside[np.argmin(np.abs(inside - middle))])
    return middle


def bisection(packages: np.ndarray, lines: np.ndarray, begin: int, stop: int, limit: int, overlap: int) -> Pieces:
    """Even pieces: halves are cut again while longer than the limit less the overlap; then overlaps are attached."""
    cores, todo = [], [(begin, stop)]
    while todo:
        b, s = todo.pop()
        if s - b <= limit - overlap or s - b < 2:
            cores.append((b, s))
        else:
            cut = _cut(packages, lines, b, s)
            todo += [(cut, s), (b, cut)]
    return [(b if b == begin else _overlapped(lines, b, begin, overlap), s) for b, s in cores]


def _ends(tokens: np.ndarray, ends: np.ndarray, stop: int) -> np.ndarray:
    """Where pieces end: at the end of the content, before a package, before a line, or inside a line."""
    after = tokens[np.minimum(ends, len(tokens) - 1)]
    return np.where(ends == stop, "end", np.where(after == PACKAGE, "package", np.where(after == LINE, "line", "inside")))


def _split(plan: Callable[..., Pieces], limit: int, overlap: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(5)]
            kinds = [np.zeros(0, "<U7")]
            lists, seq_ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            for row in np.flatnonzero(length > limit):
                tokens = lists[int(row)].values.to_numpy(zero_copy_only=False)
                content = np.flatnonzero(tokens > LAST_SPECIAL)
                if len(content) <= limit:
                    continue
                packages = np.flatnonzero(tokens == PACKAGE)
                lines = np.flatnonzero((tokens == PACKAGE) | (tokens == LINE))
                stop = int(content[-1]) + 1
                begins, ends = np.array(plan(packages, lines, int(content[0]), stop, limit, overlap)).T
                shared = np.r_[0, ends[:-1] - begins[1:]]
                for column, values in zip(columns, (np.full(len(begins), seq_ids[row]), np.arange(len(begins)), begins, ends, shared)):
                    column.append(values)
                kinds.append(_ends(tokens, ends, stop))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c).astype(np.int64)) for c in columns), pa.array(np.concatenate(kinds).tolist(), pa.string())], ["seq_id", "piece_no", "piece_start", "piece_end", "overlap", "end_kind"])

    return run


def split_sequences(df: DataFrame, seq_id: str, tokens: str, limit: int, overlap: int, plan: Callable[..., Pieces] = greedy) -> DataFrame:
    """``seq_id, piece_no, piece_start, piece_end, overlap, end_kind``: the pieces of every sequence with more than ``limit`` content tokens.

    Positions are 0-based in ``tokens``, the end is exclusive. Content is all
    but the special tokens 0, 1 and 2, from the first to the last. ``overlap``
    is how many tokens a piece shares with the one before; ``end_kind`` says
    whether it ends at the content's end, before a package, before a line or
    inside one. Sequences without id or tokens and those that fit give no rows.
    A sequence written several times gives its pieces once; different arrays
    under one id give the distinct pieces of each. Null tokens count as
    padding. Other columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap is shorter than the limit")
    rows = df.select(F.col(seq_id).cast("long").alias("seq_id"), F.expr(f"CASE WHEN exists(`{tokens}`, x -> x IS NULL) THEN transform(`{tokens}`, x -> coalesce(x, 0)) ELSE `{tokens}` END").cast("array<int>").alias("tokens"))
    long = rows.where((F.size("tokens") > limit) & F.col("seq_id").isNotNull())
    return long.mapInArrow(_split(plan, limit, overlap), "seq_id long, piece_no long, piece_start long, piece_end long, overlap long, end_kind string").distinct()
