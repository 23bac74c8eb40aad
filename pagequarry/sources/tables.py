"""Table scans and appends."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def scan(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Redistribute a scan that has too few splits to occupy the session.

    The key should be unique, so that the parts are even. Tables of many files already have more splits than cores and are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if 2 * df.rdd.getNumPartitions() > cores:
        return df
    return df.repartition(cores, *key)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A parquet folder, or no rows where nothing has been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_part(df: DataFrame, path: str, part: str, number: int) -> None:
    """Write one numbered part of a table. A repeated attempt replaces its own part, so a job
    that died half-way can simply run again."""
    df.write.mode("overwrite").parquet(f"{path}/{part}={number}")
