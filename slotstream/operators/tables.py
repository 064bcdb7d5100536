"""Keyed tables: snapshot diffs, replays, trims, first-occurrence unions and weighted order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change): added, removed or updated between two snapshots of one schema."""
    rest = [c for c in new.columns if c != key]
    a = old.select(key, F.struct(*rest).alias("__old"))
    b = new.select(key, F.struct(*rest).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "updated")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def replayed(ops: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """State after upserts and deletes: the last operation of each key since the last snapshot, deletes gone.

    ``ops`` has the columns ``op`` (snapshot, upsert, delete) and ``snapshot_at`` (order of the
    latest snapshot, the same in all rows).
    """
    last = ops.where(F.col(order) >= F.col("snapshot_at")).groupBy(key).agg(F.max_by(F.struct("op", value), order).alias("x"))
    return last.where("x.op <> 'delete'").select(key, F.col(f"x.{value}").alias(value))


def first_occurrence(parts: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """Union of ranked parts; each key keeps its row in the first part, then by ``order``."""
    ranked = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i).cast("bigint")) for i, p in enumerate(parts)])
    rest = [c for c in ranked.columns if c != key]
    return ranked.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("part", *order)).alias("x")).select(key, "x.*")


def weighted_key(weight: Column, *identity: Column, seed: str = "sample") -> Column:
    """Sort key of a weighted shuffle (Efraimidis-Spirakis with hash-drawn numbers); zero weights last."""
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *identity)), 1, 12), 16, 10).cast("double") + 1) / (16.0**12 + 1)
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def top_per_group(frame: DataFrame, group: list[str], order: list[Column], most: int) -> DataFrame:
    return frame.withColumn("__turn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__turn") <= most).drop("__turn")
