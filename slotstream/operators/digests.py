"""Membership digests over hash prefixes, as tables of set bits: built, and asked, by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (three hexadecimal digits) and hash functions of a value.
BITS, HASHES = 4096, 3


def bits(digest: str) -> Column:
    """The bit positions of a hexadecimal hash: three digits each, from the third, seventh and eleventh on."""
    return F.array(*[F.conv(F.substring(digest, 3 + 4 * k, 3), 16, 10).cast("int") for k in range(HASHES)])


def filters(values: DataFrame, digest: str) -> DataFrame:
    """(prefix, bit) of the set bits of each prefix's filter: at most ``BITS`` rows a prefix."""
    return values.select(F.substring(digest, 1, 1).alias("prefix"), F.explode(bits(digest)).alias("bit")).distinct()


def lacking(values: DataFrame, known: DataFrame, digest: str) -> DataFrame:
    """The values that the filters ``known`` surely don't contain: at least one of their bits isn't set.

    Whether a value is in doubt is asked bit by bit; the filter side is small by its bound.
    """
    columns = values.columns
    asked = values.select("*", F.substring(digest, 1, 1).alias("prefix"), F.explode(bits(digest)).alias("bit"))
    met = asked.join(F.broadcast(known.withColumn("set", F.lit(1))), ["prefix", "bit"], "left")
    return met.groupBy(*columns).agg(F.count("set").alias("n")).where(F.col("n") < HASHES).select(*columns)
