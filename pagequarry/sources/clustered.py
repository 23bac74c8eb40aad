"""Tables whose files are sorted by a key, with an index of their files.

A lookup of any number of values reads the index, then only the files that may hold one of them,
and of these only the row groups and pages inside the ranges that the values fill. What it collects
has a row per file and cell, never a row per value.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.operators.joins import join_unique
from pagequarry.session import materialise

# Ranges that a scan is filtered by; each adds a comparison per row that is read.
MOST_RANGES = 100
# Cells in which the least and largest wanted value are found, over all files.
MOST_CELLS = 1 << 16
# Row groups of the files, so that a range skips most of a large file.
ROW_GROUP_BYTES = 16 * 1024 * 1024


def merged_ranges(low: np.ndarray, high: np.ndarray, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most `most` ranges that cover all of low[i] to high[i] and leave out the widest gaps."""
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order]) if len(high) else high
    if not len(low):
        return []
    gaps = low[1:].astype(np.float64) - high[:-1].astype(np.float64)
    wide = np.flatnonzero(gaps > 1)
    cuts = np.sort(wide[np.argsort(-gaps[wide], kind="stable")[: most - 1]])
    firsts, lasts = np.r_[0, cuts + 1], np.r_[cuts, len(low) - 1]
    return list(zip(low[firsts].tolist(), high[lasts].tolist()))


def within(column: str, ranges: list[tuple[int, int]]) -> Column:
    """Whether a column lies in one of the ranges; the comparisons reach the scan."""
    parts = [F.col(column).between(a, b) if a != b else F.col(column) == a for a, b in ranges]
    while len(parts) > 1:  # a flat tree, not a deep one
        parts = [reduce(lambda a, b: a | b, parts[n : n + 2]) for n in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(False)


def _ends(cells: DataFrame, value: str) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    found = cells.agg(F.min(value).alias("low"), F.max(value).alias("high")).toArrow()
    return found.column("low").to_numpy(), found.column("high").to_numpy(), found


def ranges_of(wanted: DataFrame, column: str, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges that hold all wanted values, from the least and largest one of each of MOST_CELLS
    cells of equal width. `wanted` should be a written table."""
    low, high = wanted.agg(F.min(column), F.max(column)).first()
    if low is None:
        return []
    width = max(1, -(-(high - low + 1) // MOST_CELLS))
    cell = F.floor((F.col(column).cast("decimal(20,0)") - F.lit(low)) / F.lit(width))
    lows, highs, _ = _ends(wanted.filter(F.col(column).isNotNull()).groupBy(cell.alias("cell")), column)
    return merged_ranges(lows, highs, most)


def write_clustered(df: DataFrame, path: str, by: list[str], files: int) -> None:
    """Write rows sorted by `by` in about `files` files, and an index of these.

    The first of `by` is what lookups use; the others, of which one should be unique, keep a value
    that holds most rows from filling one file. All of `by` are integers. The path must be new: the
    index is written last, and a table without one cannot be opened.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(files, *by).sortWithinPartitions(*by)
    placed.write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/rows")
    rows = spark.read.schema(df.schema).parquet(f"{path}/rows")
    ends = [x for name in by for x in (F.min(name).alias(f"low_{name}"), F.max(name).alias(f"high_{name}"))]
    rows.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), *ends).coalesce(1).write.parquet(f"{path}/files")


class ClusteredTable:
    """A table that `write_clustered` wrote."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | None = None) -> None:
        self.spark, self.path = spark, path
        self.schema = schema or spark.read.parquet(f"{path}/rows").schema
        # One row per file: as much as the driver lists to read the table at all.
        self.index = spark.read.parquet(f"{path}/files").toArrow()

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def _files(self, column: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Files in the order of a column, with the least and the largest value of each."""
        table = self.index.filter(pc.is_valid(self.index.column(f"low_{column}"))).sort_by([(f"low_{column}", "ascending"), (f"high_{column}", "ascending")])
        low, high = (table.column(f"{end}_{column}").to_numpy() for end in ("low", "high"))
        if (np.diff(high) < 0).any():
            raise ValueError(f"the files of {self.path} are not in the order of {column}")
        return table.column("file").to_pylist(), low, high

    def near(self, column: str, wanted: DataFrame) -> DataFrame:
        """The rows of the ranges that the wanted values of an indexed column fill: all that have
        one of them, and few others. `wanted` should be a written table."""
        names, low, high = self._files(column)
        per_file = max(1, MOST_CELLS // max(1, len(names)))
        shared = self.spark.sparkContext.broadcast((low, high))

        @F.arrow_udf("array<struct<file: int, cell: int>>")
        def places(values: pa.Array) -> pa.Array:
            low, high = shared.value
            known = values.drop_null().to_numpy()
            # A value may lie in several files: where one ends and the next begins.
            first, last = np.searchsorted(high, known, "left"), np.searchsorted(low, known, "right")
            counts = np.maximum(last - first, 0)
            owner = np.repeat(np.arange(len(known)), counts)
            file = np.repeat(first, counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            span = high[file].astype(np.float64) - low[file] + 1
            cell = np.minimum((known[owner].astype(np.float64) - low[file]) / span * per_file, per_file - 1)
            every = np.zeros(len(values), np.int64)
            every[values.is_valid().to_numpy(zero_copy_only=False)] = counts
            pairs = pa.StructArray.from_arrays([pa.array(file, pa.int32()), pa.array(cell.astype(np.int32))], ["file", "cell"])
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(every)], pa.int32()), pairs)

        value = F.col(column).cast("bigint")
        placed = wanted.select(value.alias("value"), F.explode(places(value)).alias("place"))
        lows, highs, found = _ends(placed.groupBy("place.file", "place.cell"), "value")
        shared.unpersist()
        chosen = sorted(set(found.column("file").to_pylist()))
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/rows/{names[n]}" for n in chosen])
        return rows.filter(within(column, merged_ranges(lows, highs)))

    def fetch(self, column: str, wanted: DataFrame) -> DataFrame:
        """The rows whose column is among the wanted values, each once. Values that are null or not
        there give nothing; one value may hold any share of the rows."""
        wanted = materialise(wanted.select(F.col(column).cast("bigint").alias(column)).distinct(), "wanted")
        return join_unique(self.near(column, wanted), wanted, column, "left_semi")
