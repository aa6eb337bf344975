"""The attribute version known at an event's time.

Entities are hash-partitioned into buckets of even size. What an entity costs is
its events and, for each day that these fall on, its versions. One that costs
more than a bucket should hold is split by day; a day with too many events is
split by event, each part getting the day's versions, and a day with too many
versions is split by version, each part getting the day's events and the best of
the parts' answers being taken. Versions of entities without events are dropped.

Within a bucket, versions become a current-state history per entity and day in
order of availability (of the versions in force that day, the best one known so
far), with ties settled beforehand, and an embedded DuckDB ASOF LEFT JOIN picks
for every event the last state available at its time.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.storage import materialise

BUCKET_ROWS = 60_000

_JOIN = """
WITH days AS (SELECT DISTINCT entity, day FROM events),
known AS (
    SELECT d.entity, d.day, v.known_us, max(row(v.from_day, v.known_us, v.version_id)) AS best
    FROM days d JOIN versions v ON v.entity = d.entity AND v.from_day <= d.day AND (v.to_day IS NULL OR d.day < v.to_day)
    GROUP BY d.entity, d.day, v.known_us
),
states AS (
    SELECT entity, day, known_us, max(best) OVER (PARTITION BY entity, day ORDER BY known_us ROWS UNBOUNDED PRECEDING) AS best
    FROM known
)
SELECT e.event_id, e.entity, e.day, e.ts_us, e.chunks, s.best[1] AS from_day, s.best[2] AS known_us, s.best[3] AS version_id
FROM events e ASOF LEFT JOIN states s ON e.entity = s.entity AND e.day = s.day AND e.ts_us >= s.known_us
"""


_FOUND = pa.schema([("event_id", pa.int64()), ("entity", pa.int64()), ("day", pa.date32()), ("ts_us", pa.int64()), ("chunks", pa.int32()), ("from_day", pa.date32()), ("known_us", pa.int64()), ("version_id", pa.int64())])


def _bucket_join(events: pa.Table, versions: pa.Table) -> pa.Table:
    import duckdb

    if not events.num_rows:
        return _FOUND.empty_table()
    with duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""}) as db:  # a bucket fits; nothing spills beside Spark
        db.register("events", events)
        db.register("versions", versions)
        return db.sql(_JOIN).to_arrow_table().select(_FOUND.names).cast(_FOUND)


def asof_versions(
    events: DataFrame, versions: DataFrame, *, event_id: str, entity: str, day: str, ts_us: str, version_id: str, effective_from: str, effective_to: str, known_us: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """``event_id, entity, day, ts_us, version_id``: one row per row of ``events``.

    The version is one of the event's entity in force on ``day`` (from
    ``effective_from`` up to but not including ``effective_to``; null: no end)
    and known at ``ts_us`` (``known_us`` not later; null: never known). Of
    several it is the one with the latest ``effective_from``, then the latest
    ``known_us``, then the largest id. Intervals that end before they begin
    hold on no day. Events without entity, day or time, and those without such
    a version, come out with a null version. Repeated events come out as often
    as they occur; repeated versions count once. Other columns are not read.
    """
    lines = events.select(F.col(event_id).alias("event_id"), F.col(entity).cast("long").alias("entity"), F.col(day).alias("day"), F.col(ts_us).alias("ts_us"))
    datable = F.col("entity").isNotNull() & F.col("day").isNotNull() & F.col("ts_us").isNotNull()
    usable = lines.where(datable)
    states = versions.select(
        F.col(version_id).alias("version_id"), F.col(entity).cast("long").alias("entity"), F.col(effective_from).alias("from_day"), F.col(effective_to).alias("to_day"), F.col(known_us).alias("known_us")
    ).where("entity IS NOT NULL AND from_day IS NOT NULL AND known_us IS NOT NULL AND (to_day IS NULL OR from_day < to_day)")

    daily = usable.groupBy("entity", "day").agg(F.count(F.lit(1)).alias("n"))
    held = states.groupBy(F.col("entity").alias("of")).agg(F.count(F.lit(1)).alias("n_versions"))
    days = daily.groupBy("entity").agg(F.collect_list(F.struct("day", "n")).alias("days"))  # an entity's days
    cost = F.expr("aggregate(days, 0L, (s, d) -> s + d.n) + size(days) * n_versions")
    costs = materialise(days.join(held, F.col("entity") == F.col("of"), "left").select("entity", "days", F.coalesce("n_versions", F.lit(0)).alias("n_versions")).withColumn("cost", cost), "costs")
    buckets = max(1, -(-(costs.agg(F.sum("cost").alias("c")).head()["c"] or 0) // bucket_rows))
    parts = lambda n: F.expr(f"greatest(1, CAST(ceil({n} / {bucket_rows}) AS INT))")
    # Written tables: Spark knows their size and broadcasts them only where they are small.
    units = materialise(costs.where(F.col("cost") > bucket_rows).select("entity", "n_versions", F.inline("days")).select("entity", "day", parts("n").alias("parts"), parts("n_versions").alias("chunks")), "units")

    bucket = F.expr(f"pmod(xxhash64(entity, unit, part, chunk), {buckets})").alias("bucket")
    left = (
        usable.join(units.select(F.col("entity").alias("of"), F.col("day").alias("unit"), "parts", "chunks"), (F.col("entity") == F.col("of")) & (F.col("day") == F.col("unit")), "left")
        .withColumn("part", F.expr("pmod(xxhash64(event_id), coalesce(parts, 1))"))
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)")))
        .select("event_id", "entity", "day", "ts_us", "chunks", bucket)
    )
    wanted = states.join(costs.select(F.col("entity").alias("of"), (F.col("cost") > bucket_rows).alias("split")), F.col("entity") == F.col("of"))
    whole = wanted.where("NOT split").select("version_id", "entity", "from_day", "to_day", "known_us", F.lit(None).cast("date").alias("unit"), F.lit(0).cast("long").alias("part"), F.lit(0).alias("chunk"))
    in_force = F.filter("units", lambda u: (u["day"] >= F.col("from_day")) & (F.col("to_day").isNull() | (u["day"] < F.col("to_day"))))
    divided = (
        wanted.where("split")
        .join(units.groupBy(F.col("entity").alias("whose")).agg(F.collect_list(F.struct(F.col("day"), "parts", "chunks")).alias("units")), F.col("entity") == F.col("whose"))
        .select("version_id", "entity", "from_day", "to_day", "known_us", F.explode(in_force).alias("u"))
        .select("version_id", "entity", "from_day", "to_day", "known_us", F.col("u.day").alias("unit"), F.explode(F.expr("sequence(0L, u.parts - 1L)")).alias("part"), F.expr("CAST(pmod(xxhash64(version_id, from_day, known_us), u.chunks) AS INT)").alias("chunk"))
    )
    right = whole.unionByName(divided).select("version_id", "entity", "from_day", "to_day", "known_us", bucket)
    found = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_bucket_join, "event_id long, entity long, day date, ts_us long, chunks int, from_day date, known_us long, version_id long")
    names = ["event_id", "entity", "day", "ts_us"]
    if units.where("chunks > 1").isEmpty():
        answered = found.select(*names, "version_id")
    else:
        found = materialise(found, "found")
        best = F.max(F.when(F.col("version_id").isNotNull(), F.struct("from_day", "known_us", "version_id"))).alias("best")
        merged = found.where("chunks > 1").groupBy(*names, "chunks").agg(best, F.count(F.lit(1)).alias("n"))
        merged = merged.select(*names, F.col("best.version_id").alias("version_id"), F.explode(F.expr("sequence(1L, n DIV chunks)")).alias("copy")).drop("copy")
        answered = found.where("chunks = 1").select(*names, "version_id").unionByName(merged)
    return answered.unionByName(lines.where(~datable).withColumn("version_id", F.lit(None).cast("long")))
