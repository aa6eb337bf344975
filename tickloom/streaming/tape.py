"""Structured Streaming forms: state per key, and windowed counts.

Once a stream is drained, gaps and window counts equal the batch results in
whatever order files come (windows as far as the watermark waits); blocks number
a day's events in the order they come.
"""

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tickloom.plans.storage import shared_dir
from tickloom.sources.tables import table


def stream_table(spark: SparkSession, root: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """The table as a stream of files; NTZ times become UTC timestamps, which watermarks need. By default a micro-batch takes all files there are."""
    schema = table(spark, root, name).schema
    # A pattern, since a stream takes a plain path for a folder and the table may be one file.
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    stream = (reader.option("maxFilesPerTrigger", str(files_per_batch)) if files_per_batch else reader).parquet(f"{root}/{name}.parque[t]")
    return stream.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Run the stream over all that is there now and return what it wrote.

    ``append`` keeps every batch's rows; ``complete`` keeps the last result.
    Data and checkpoint lie in the shared folder; a batch that is run again
    after a failure overwrites its own output.
    """
    spark = stream.sparkSession
    base = os.path.join(shared_dir(spark), f"tickloom-stream-{uuid.uuid4().hex}")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number if mode == 'append' else 0}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


def _by_day(events: DataFrame, key: str, ts: str, item: str, buckets: int | None) -> GroupedData:
    """A day's events of a bucket of keys; by default there are as many buckets as the stream's state has partitions."""
    n = buckets or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select(F.col(key).alias("key"), F.col(item).alias("item"), F.unix_micros(ts).alias("us")).where("key IS NOT NULL AND us IS NOT NULL AND item IS NOT NULL")
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(n))).withColumn("day", F.floor(F.col("us") / 86_400_000_000).cast("long")).groupBy("bucket", "day")


def _arrived(frames: Iterable[pd.DataFrame]) -> np.ndarray:
    return np.concatenate([np.zeros((0, 3), np.int64), *(f[["key", "us", "item"]].to_numpy(np.int64) for f in frames)])


def day_gaps(events: DataFrame, key: str, ts: str, item: str, buckets: int | None = None) -> DataFrame:
    """``key, day, item, nth, us, version, gap_us``: microseconds since the key's previous event of the day, null for its first.

    The day's events are kept as state. A micro-batch may be the whole table, so
    a group is a day of a bucket of keys and never all of a key (``gaps`` joins
    the days); many keys share a call, and more ``buckets`` make groups smaller,
    down to one key's day. A late event comes out with its own gap and with the
    changed gap of the event after it, under a higher version. ``nth`` tells
    repeated events apart.
    """

    def step(name: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, version = (np.frombuffer(state.get[0], np.int64).reshape(-1, 3), state.get[1] + 1) if state.exists else (np.zeros((0, 3), np.int64), 0)
        rows = np.concatenate([held, _arrived(frames)])
        new = np.arange(len(rows)) >= len(held)
        order = np.lexsort((new, rows[:, 2], rows[:, 1], rows[:, 0]))
        rows, new = rows[order], new[order]
        follows = np.r_[False, rows[1:, 0] == rows[:-1, 0]]
        again = np.r_[False, (rows[1:] == rows[:-1]).all(axis=1)]
        at = np.arange(len(rows))
        gap = pd.array(np.r_[0, np.diff(rows[:, 1])], "Int64")
        gap[~follows] = pd.NA
        state.update((rows.tobytes(), version))
        nth = at - np.maximum.accumulate(np.where(again, 0, at))
        out = pd.DataFrame({"key": rows[:, 0], "day": name[1], "item": rows[:, 2], "nth": nth, "us": rows[:, 1], "version": version, "gap_us": gap})
        yield out[new | (follows & np.r_[False, new[:-1]])]

    kind = "key long, day long, item long, nth long, us long, version long, gap_us long"
    return _by_day(events, key, ts, item, buckets).applyInPandasWithState(step, kind, "held binary, version long", "append", "NoTimeout")


def gaps(drained_days: DataFrame) -> DataFrame:
    """``key, item, gap_us``: microseconds since the key's previous event, null for its first, from what ``day_gaps`` wrote.

    Of each event the last version counts. A day's first event looks at the
    last one of the days before, of which there is one row per key and day.
    """
    final = drained_days.groupBy("key", "day", "item", "nth", "us").agg(F.max_by("gap_us", "version").alias("gap_us"))
    lasts = drained_days.groupBy("key", "day").agg(F.max("us").alias("last"))
    before = lasts.select("key", "day", F.lag("last").over(W.partitionBy("key").orderBy("day")).alias("before"))
    return final.join(before, ["key", "day"], "left").select("key", "item", F.coalesce("gap_us", F.col("us") - F.col("before")).alias("gap_us"))


def day_places(events: DataFrame, key: str, ts: str, item: str, buckets: int | None = None) -> DataFrame:
    """``key, day, item, place``: each event's number, from 0, within its key's day in the order they come.

    How many came of each key is kept as state; groups are as in ``day_gaps``.
    """

    def step(name: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, seen = np.frombuffer(state.get[0], np.int64).reshape(2, -1) if state.exists else np.zeros((2, 0), np.int64)
        rows = _arrived(frames)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        own, first, n = np.unique(rows[:, 0], return_index=True, return_counts=True)
        known, of = np.unique(np.r_[keys, own], return_inverse=True)
        before, after = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        before[of[: len(keys)]] = seen
        after[of[len(keys) :]] = n
        state.update((np.stack([known, before + after]).tobytes(),))
        place = np.arange(len(rows)) + np.repeat(before[of[len(keys) :]] - first, n)
        yield pd.DataFrame({"key": rows[:, 0], "day": name[1], "item": rows[:, 2], "place": place})

    return _by_day(events, key, ts, item, buckets).applyInPandasWithState(step, "key long, day long, item long, place long", "seen binary", "append", "NoTimeout")


def blocks(drained_days: DataFrame, size: int) -> DataFrame:
    """``key, item, block``: each key's events in blocks of ``size``, from what ``day_places`` wrote and the counts of the days before."""
    counts = drained_days.groupBy("key", "day").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("key", "day", F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return drained_days.join(before, ["key", "day"], "left").select("key", "item", F.floor((F.col("before") + F.col("place")) / size).cast("long").alias("block"))


def windowed(events: DataFrame, ts: str, window: str, late: str, *by: str) -> DataFrame:
    """``start_us, by, n``: events per tumbling window; those later than ``late`` behind the stream are dropped from open streams."""
    counts = events.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.unix_micros(F.col("window.start")).alias("start_us"), *by, "n")
