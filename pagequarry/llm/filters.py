"""A filter of fixed size for the keys of one side of a join.

Rows whose key the filter does not know need not be shuffled. It has 2 ** FILTER_BITS bits for any
number of keys: a full one lets more rows through, and the join that follows decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 26


def place_of(key: str) -> tuple[Column, Column]:
    """Word and bit of a key; a null has a place as well."""
    place = F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS))
    return F.shiftright(place, 6), F.pmod(F.xxhash64(key), F.lit(64))


def filter_words(keys: DataFrame, key: str) -> np.ndarray:
    """The bits of all keys, in words of 64."""
    word, bit = place_of(key)
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int"))
    found = keys.groupBy(word.alias("word")).agg(F.bit_or(mask).alias("bits")).toArrow()
    words = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words


def known_to(keys: DataFrame, key: str, of: str) -> Column:
    """Whether a row's `of` may be among the values of `key`; keys should be a written table."""
    shared = keys.sparkSession.sparkContext.broadcast(filter_words(keys, key))

    @F.arrow_udf("boolean")
    def known(word: pa.Array, bit: pa.Array) -> pa.Array:
        return pa.array((shared.value[word.to_numpy()] >> bit.to_numpy() & 1).astype(bool))

    return known(*place_of(of))
