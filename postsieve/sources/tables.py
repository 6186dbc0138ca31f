"""Reading the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A file of up to this size often holds one row group or two, which one task reads whole.
SMALL_FILE = 128 << 20


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder. Fewer small files than cores are dealt over all cores; larger tables are left as their files are split."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    files, cores = len(df.inputFiles()), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if files < cores and 1 << 20 < size <= files * SMALL_FILE else df
