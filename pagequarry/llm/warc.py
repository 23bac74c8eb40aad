"""Fixity audit of archive replicas with Merkle trees over ordered offset ranges.

A manifest has one row per record: file_id, offset, length, digest and the record's id. Records of
64 KiB of offsets make a leaf, 256 leaves a node, and so on up to the file and then over files up
to one root. Two replicas are compared from the root; below a pair of equal nodes nothing is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry.session import materialise
from pagequarry.sources.tables import scan

RANGE_BITS = 16
FANOUT_BITS = 8
PAGES_PER_FILE = 512
KEY = ["file_id", "range"]


def _joined(children: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(children), "\n"), 256)


def leaves(manifest: DataFrame) -> DataFrame:
    """file_id, range and hash of every range; equal rows are counted before they are gathered, so
    a leaf holds no more rows than its range has distinct records."""
    rows = manifest.groupBy("file_id", "offset", "length", "digest").count()
    line = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), "length", "digest", "count")
    by = [F.col("file_id"), F.shiftright("offset", RANGE_BITS).alias("range")]
    return rows.groupBy(*by).agg(_joined(F.collect_list(line)).alias("hash"))


def _above(of_files: bool) -> list[Column]:
    if of_files:
        return [F.shiftright("file_id", FANOUT_BITS).alias("file_id"), F.lit(0).cast("bigint").alias("range")]
    return [F.col("file_id"), F.shiftright("range", FANOUT_BITS).alias("range")]


def parents(nodes: DataFrame, of_files: bool) -> DataFrame:
    """The next level: at most 2**FANOUT_BITS neighbours under one hash."""
    line = F.concat_ws(":", F.lpad(F.col("file_id").cast("string"), 20, "0"), F.lpad(F.col("range").cast("string"), 20, "0"), "hash")
    return nodes.groupBy(*_above(of_files)).agg(_joined(F.collect_list(line)).alias("hash"))


def levels_over(*leaves_of: DataFrame) -> list[bool]:
    """The levels above the leaves up to one root: first within files (False), then over files."""
    every = reduce(lambda a, b: a.unionByName(b), leaves_of)
    file_id, place = every.agg(F.max(F.abs("file_id")), F.max(F.abs("range"))).first()
    count = lambda most: -(-int(most or 0).bit_length() // FANOUT_BITS)
    return [False] * count(place) + [True] * count(file_id)


def tree(lowest: DataFrame, levels: list[bool]) -> list[DataFrame]:
    """All levels, the leaves first, each written when its children are."""
    found = [lowest]
    for of_files in levels:
        found.append(materialise(parents(found[-1], of_files), "merkle-level"))
    return found


def _differing(one: DataFrame, two: DataFrame) -> DataFrame:
    both = one.withColumnRenamed("hash", "_one").join(two.withColumnRenamed("hash", "_two"), KEY, "full")
    return both.filter(~F.col("_one").eqNullSafe(F.col("_two"))).select(*KEY)


def _below(nodes: DataFrame, bad: DataFrame, of_files: bool) -> DataFrame:
    """The children of differing nodes."""
    named = bad.select(*(F.col(name).alias(f"_bad_{name}") for name in KEY))
    placed = nodes.select("*", *(c.alias(f"_{name}") for c, name in zip(_above(of_files), KEY)))
    at = [F.col(f"_{name}") == F.col(f"_bad_{name}") for name in KEY]
    return placed.join(named, at, "left_semi").select(*KEY, "hash")


def audit(original: DataFrame, replica: DataFrame) -> DataFrame:
    """Records that differ: file_id, offset, both lengths and ids, and the damage.

    The damage is `missing` in the replica, `extra` there, or `changed`. Rows without a file or an
    offset are not part of an archive and are left out. Repeated rows count: a record that is there
    twice in one replica and once in the other is `changed`. Empty replicas agree.
    """
    sides = [m.filter("file_id is not null and offset is not null").select("file_id", "offset", "length", F.coalesce("digest", F.lit("")).alias("digest"), "record_id") for m in (original, replica)]
    lowest = [materialise(leaves(side), "merkle-leaves") for side in sides]
    levels = levels_over(*lowest)
    one, two = (tree(nodes, levels) for nodes in lowest)
    bad = materialise(_differing(one[-1], two[-1]), "merkle-differences")
    for k, of_files in reversed(list(enumerate(levels))):
        near = [_below(nodes, bad, of_files) for nodes in (one[k], two[k])]
        bad = materialise(_differing(*near), "merkle-differences")
    found = []
    for side in sides:
        inside = side.withColumn("range", F.shiftright("offset", RANGE_BITS)).join(bad, KEY, "left_semi")
        counted = inside.groupBy("file_id", "offset", "length", "digest", "record_id").count()
        found.append(counted.groupBy("file_id", "offset").agg(F.array_sort(F.collect_list(F.struct("length", "digest", "record_id", "count"))).alias("held")))
    one, two = (f.withColumnRenamed("held", name) for f, name in zip(found, ("_one", "_two")))
    damage = F.when(F.col("_two").isNull(), "missing").when(F.col("_one").isNull(), "extra").otherwise("changed")
    first = lambda name, field: F.get(F.col(name), F.lit(0))[field]
    return (
        one.join(two, ["file_id", "offset"], "full")
        .filter(~F.col("_one").eqNullSafe(F.col("_two")))
        .select(
            "file_id",
            "offset",
            F.coalesce(first("_one", "record_id"), first("_two", "record_id")).alias("record_id"),
            first("_one", "length").alias("length"),
            first("_two", "length").alias("replica_length"),
            damage.alias("damage"),
        )
    )


def record(url: Column, html: Column) -> Column:
    """A response record as it is stored."""
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(html).cast("string"))
    return F.concat(head, F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manifests of the pages as archive files, and of a copy with damage decided by each url's hash:
    bytes changed, the end cut off, records lost, and records that only the copy has.

    A file holds PAGES_PER_FILE page numbers in order. Pages are hashed where they are read; only
    the manifest is shuffled. A null url or html is empty; pages without a number are left out.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    mark = F.substring(F.md5(url), 1, 2)
    damaged = F.when(mark == "00", F.concat(F.lit("?"), html)).when(mark == "01", F.substring(html, F.lit(1), F.length(html) - 7)).otherwise(html)
    rows = pages.filter(F.col("page_id").isNotNull()).select(
        F.col("page_id").alias("record_id"),
        F.floor(F.col("page_id") / PAGES_PER_FILE).cast("bigint").alias("file_id"),
        url.alias("_url"),
        mark.alias("_mark"),
        F.octet_length(record(url, html)).cast("bigint").alias("length"),
        F.sha2(record(url, html), 256).alias("digest"),
        F.octet_length(record(url, damaged)).cast("bigint").alias("_length"),
        F.sha2(record(url, damaged), 256).alias("_digest"),
    )
    before = Window.partitionBy("file_id").orderBy("record_id", "_url", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = materialise(rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))), "archive-manifest")
    original = placed.filter("_mark <> '03'").select("file_id", "offset", "length", "digest", "record_id")
    copy = placed.filter("_mark <> '02'").select("file_id", "offset", F.col("_length").alias("length"), F.col("_digest").alias("digest"), "record_id")
    return original, copy


def audit_pages(spark: SparkSession, folder: str) -> DataFrame:
    return audit(*replicas(scan(spark, folder, "pages")))


# Offsets follow from all pages of a file; damage from the rules above.
AUDIT_SQL = """
with placed as (
  select page_id, page_id // 512 as file_id, coalesce(url, '') as u, coalesce(html, '') as h, substr(md5(coalesce(url, '')), 1, 2) as mark,
    strlen('WARC/1.0') + 2 + strlen('WARC-Type: response') + 2 + strlen('WARC-Target-URI: ') + strlen(coalesce(url, '')) + 2
      + strlen('Content-Length: ') + strlen(strlen(coalesce(html, ''))::varchar) + 4 + strlen(coalesce(html, '')) + 4 as length
  from pages where page_id is not null
), offsets as (
  select *, coalesce(sum(length) over (partition by file_id order by page_id, u rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from placed
), copies as (
  select *, case mark when '00' then '?' || h when '01' then left(h, greatest(length(h) - 7, 0)) else h end as copied from offsets
)
select file_id, "offset", page_id as record_id,
  case when mark <> '03' then length end as length,
  case when mark <> '02' then length - strlen(h) - strlen(strlen(h)::varchar) + strlen(copied) + strlen(strlen(copied)::varchar) end as replica_length,
  case mark when '02' then 'missing' when '03' then 'extra' else 'changed' end as damage
from copies where mark in ('02', '03') or copied <> h
"""
