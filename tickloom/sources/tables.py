"""Reading the parquet tables of a run root."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` below ``root``: one parquet file or a folder of them."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def row_counts(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """``name, n_columns, n_rows`` of tables of a run; rows are counted without reading a column."""
    out = None
    for name in names:
        rows = table(spark, root, name)
        counted = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), F.lit(len(rows.columns)).cast("long").alias("n_columns"), "n_rows")
        out = counted if out is None else out.unionByName(counted)
    return out
