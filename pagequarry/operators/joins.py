"""Joins of a large table with a keyed one, where a few keys may hold most of the large table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.config import MAX_SHIPPED_BYTES
from pagequarry.session import fits

# A key of so many rows is heavy; so many of the heaviest keys are treated apart, which leaves at
# most 1 / MOST_HEAVY of all rows to any other key.
LEAST_HEAVY, MOST_HEAVY = 2_000, 1_000
_SALT = "__salt"


def heavy_keys(rows: DataFrame, keys: list[str], least: int = LEAST_HEAVY) -> list[int]:
    """The hashes of the keys that hold `least` rows and more, the heaviest ones. A null key counts
    as a key. At most MOST_HEAVY numbers reach the driver."""
    counted = rows.groupBy(F.xxhash64(*keys).alias("hash")).agg(F.count("*").alias("rows"))
    found = counted.filter(F.col("rows") >= least).orderBy(F.desc("rows"), "hash").limit(MOST_HEAVY)
    return [r["hash"] for r in found.collect()]


def join_unique(
    rows: DataFrame,
    keyed: DataFrame,
    on: str | list[str],
    how: str = "inner",
    *,
    least_heavy: int = LEAST_HEAVY,
    most_bytes: int = MAX_SHIPPED_BYTES,
) -> DataFrame:
    """`rows` joined with `keyed`, which has each key once (or few times); inner, left, left_semi
    or left_anti.

    A keyed side of at most `most_bytes` is broadcast. Otherwise the keys of `rows` are counted:
    rows of heavy keys meet the few keyed rows of these by broadcast, checked again, or else by a
    salt that deals each heavy key to all shuffle partitions; only the other rows are shuffled by
    key. A null key matches nothing. `rows` is read up to three times, the first time its keys only.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"rows of the keyed side alone are not kept: {how}")
    keys = [on] if isinstance(on, str) else list(on)
    if fits(keyed, most_bytes=most_bytes):
        return rows.join(F.broadcast(keyed), keys, how)
    heavy = heavy_keys(rows, keys, least_heavy)
    if not heavy:
        return rows.join(keyed, keys, how)
    is_heavy = F.xxhash64(*keys).isin(heavy)
    light = rows.filter(~is_heavy).join(keyed.filter(~is_heavy), keys, how)
    few = keyed.filter(is_heavy)
    if fits(few, most_bytes=most_bytes):
        return light.unionByName(rows.filter(is_heavy).join(F.broadcast(few), keys, how))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.filter(is_heavy).withColumn(_SALT, F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    copies = few.withColumn(_SALT, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return light.unionByName(dealt.join(copies.hint("shuffle_hash"), [*keys, _SALT], how).drop(_SALT))
