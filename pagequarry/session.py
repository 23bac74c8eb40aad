"""Session conventions: time zone, and the shared folder for work that must outlive an executor."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.config import MAX_BROADCAST_ROWS, MAX_SHIPPED_BYTES

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def build_session(app: str, cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship_package(builder.getOrCreate())


_shipped_to: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers of a session, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped_to:
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="pagequarry-"), "pagequarry")
        archive = shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        _shipped_to.add(context.applicationId)
    return spark


_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession, rows: int = 1_000) -> SparkSession:
    """Hand texts to Python in batches of so many rows, unless the session names a size of its own:
    a default batch of long texts takes more memory beside the heap than all else."""
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(rows))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A machine-local folder is used only where the whole session is one machine.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="pagequarry-")
    spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once under the shared folder and read back, so later steps never recompute it."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# What a row takes in a broadcast table besides its values.
_ROW_BYTES = 64


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row holds."""

    def size(name: str, kind: T.DataType) -> Column:
        column = F.col(f"`{name}`")
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(column)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.TimestampType)):
            return F.array_size(column) * 8
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(column)))
        return F.lit(8)

    sizes = [F.coalesce(size(f.name, f.dataType), F.lit(0)).cast("bigint") for f in df.schema.fields]
    return reduce(lambda a, b: a + b, sizes, F.lit(_ROW_BYTES).cast("bigint"))


def fits(df: DataFrame, most: int = MAX_BROADCAST_ROWS, most_bytes: int = MAX_SHIPPED_BYTES) -> bool:
    """Whether a table has at most so many rows and bytes; reads one row more than that at most."""
    if not most_bytes:
        return False
    head = df.limit(min(most, most_bytes // _ROW_BYTES) + 1)
    rows, size = head.agg(F.count("*"), F.coalesce(F.sum(row_bytes(head)), F.lit(0))).first()
    return rows <= most and size <= most_bytes


def broadcast_if_small(df: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark a table for broadcast when its rows and bytes, counted first, are few."""
    return F.broadcast(df) if fits(df, most) else df
