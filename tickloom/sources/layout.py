"""Partitioned, sorted parquet tables with an inventory of their files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_BITS = 48


def event_id(shard: Column, counter: Column) -> Column:
    """A shard and a counter below 2^48 in one signed id."""
    return F.shiftleft(shard.cast("long"), SHARD_BITS).bitwiseOR(counter.cast("long"))


def shard_of(id_: Column) -> Column:
    return F.shiftrightunsigned(id_, SHARD_BITS)


def counter_of(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit((1 << SHARD_BITS) - 1))


def write_monthly(df: DataFrame, path: str, day: str, order: list[str]) -> None:
    """Parquet below ``trade_month=yyyy-MM`` folders, each file sorted by ``order``; several files for a large month."""
    months = df.withColumn("trade_month", F.date_format(day, "yyyy-MM"))
    spread = months.repartitionByRange("trade_month", *order).sortWithinPartitions("trade_month", *order)
    spread.write.mode("overwrite").option("compression", "zstd").partitionBy("trade_month").parquet(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``file, n_bytes, sha256`` of every parquet file below ``path``; files are bounded by the writer."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.expr("substring(path, instr(path, 'trade_month='))").alias("file"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, n_rows`` below ``path``."""
    rows = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select(F.expr("substring(p, instr(p, 'trade_month='))").alias("file"), "n_rows")


def mismatches(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """``file, problem``: recorded files that are missing, of another size, or of other content, in this order of precedence."""
    now = found.select("file", F.col("n_bytes").alias("b"), F.col("sha256").alias("s"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("b") != F.col("n_bytes"), "size").when(F.col("s") != F.col("sha256"), "sha256")
    return recorded.join(now, "file", "left").select("file", problem.alias("problem")).where("problem IS NOT NULL")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``file, n_bytes, sha256, n_rows`` of the files below ``path``; rows are counted without reading a column."""
    return inventory(spark, path).join(file_rows(spark, path), "file", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def write_manifest(spark: SparkSession, path: str, at: str, version: str) -> None:
    """Record the files below ``path`` as a table at ``at``, with the version of their schema."""
    manifest(spark, path).withColumn("schema_version", F.lit(version)).write.mode("overwrite").parquet(at)


def read_manifest(spark: SparkSession, at: str, version: str) -> DataFrame:
    """The record at ``at``; one of another schema version fails the query."""
    own = F.col("schema_version")
    kept = F.when(own == version, own).otherwise(F.raise_error(F.concat(F.lit(f"schema version is not {version}: "), F.coalesce(own, F.lit("null")))))
    return spark.read.parquet(at).withColumn("schema_version", kept)
