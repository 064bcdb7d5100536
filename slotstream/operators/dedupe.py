"""Keyed deduplication: conflicts, time-to-live, last-writer-wins and arbitration.

Batch forms of the stateful operators.  All partition on the key alone, so a frame that is already
hashed on a prefix of the key is not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("slot", "idx")


def observation(key: tuple[str, ...] = KEY, signature: str = "sig", order: str = "arrival", stage: str | None = None) -> Column:
    """Accepted, Duplicate or Conflict for each arrival of a key.

    The first signature of a key stays its signature: another one is a Conflict and changes
    nothing; the same one is Accepted once per stage and a Duplicate after that.
    """
    first = F.first(signature).over(Window.partitionBy(*key).orderBy(order))
    turn = F.row_number().over(Window.partitionBy(*key, signature, *([stage] if stage else [])).orderBy(order))
    return F.when(F.col(signature) != first, "Conflict").when(turn > 1, "Duplicate").otherwise("Accepted")


def observed(frame: DataFrame, **how) -> DataFrame:
    return frame.withColumn("observation", observation(**how))


def accepted(frame: DataFrame, **how) -> DataFrame:
    """The fragment that each key keeps: the first to arrive."""
    return observed(frame, **how).where("observation = 'Accepted'")


def since(frame: DataFrame, slot: str, lag: int) -> DataFrame:
    """Rows whose slot lies within ``lag`` of the newest; the floor is one broadcast row."""
    floor = frame.agg((F.max(slot) - lag).alias("__floor"))
    return frame.join(F.broadcast(floor), F.col(slot) >= F.col("__floor")).drop("__floor")


def late(frame: DataFrame, slot: str, order: str, lag: int, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``late``: the slot lies below the running newest slot less ``lag``."""
    newest = F.max(slot).over(Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return frame.withColumn("late", F.col(slot) < newest - lag)


def first_per_key(frame: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """First arrival of each key, by partial aggregation (no sort, and a hot key is combined before the shuffle)."""
    rest = [c for c in frame.columns if c not in key]
    return frame.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("__row")).select(*key, "__row.*").select(*frame.columns)


def newest_per_key(frame: DataFrame, key: tuple[str, ...], rank: Column) -> DataFrame:
    """Last-writer-wins: the row of each key with the greatest ``rank``."""
    rest = [c for c in frame.columns if c not in key]
    return frame.groupBy(*key).agg(F.max_by(F.struct(*rest), rank).alias("__row")).select(*key, "__row.*").select(*frame.columns)


def promoted(frame: DataFrame, key: str, source: str, priority: str, order: str, mode: str = "promote") -> DataFrame:
    """Fan-in arbitration over (source, key): adds ``emitted``.

    A (source, key) seen before is dropped.  ``emit_all`` emits the rest; ``first_seen`` the first
    of a key; ``promote`` also those of strictly higher priority than all emitted before.
    """
    turn = F.row_number().over(Window.partitionBy(key, source).orderBy(order))
    fresh = frame.withColumn("__new", turn == 1)
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.max(F.when(F.col("__new"), F.col(priority))).over(before)
    emit = {"emit_all": F.lit(True), "first_seen": best.isNull(), "promote": best.isNull() | (F.col(priority) > best)}[mode]
    return fresh.withColumn("emitted", F.col("__new") & emit).drop("__new")
