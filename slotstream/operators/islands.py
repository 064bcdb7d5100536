"""Gaps and islands over fragment indexes: reassembly, prefixes, gaps and erasure sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slot():
    """Fragments of a slot in index order."""
    return Window.partitionBy("slot").orderBy("idx")


def with_island(fragments: DataFrame) -> DataFrame:
    """Adds ``island``: the same number for contiguous indexes of a slot (one row per index)."""
    return fragments.withColumn("island", F.col("idx") - F.row_number().over(_slot()))


def datasets(fragments: DataFrame) -> DataFrame:
    """Completed datasets of each slot in final state.

    Boundaries (``data_complete``) split islands.  A dataset begins after the boundary before it
    if that is contiguous, else where contiguity begins; without such a boundary a lone fragment
    beyond index 0 is no dataset.
    """
    marked = with_island(fragments)
    before = Window.partitionBy("slot", "island").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn("part", F.coalesce(F.count_if("data_complete").over(before), F.lit(0)))
    found = marked.groupBy("slot", "island", "part").agg(
        F.min("idx").alias("start_index"), F.max("idx").alias("end_index"), F.count("*").alias("n_shreds"), F.sum("payload_len").alias("payload_len"), F.bool_or("data_complete").alias("done"), F.bool_or("last_in_slot").alias("last_in_slot")
    )
    anchored = (F.col("part") > 0) | (F.col("start_index") == 0)
    return found.where(F.col("done") & (anchored | (F.col("n_shreds") >= 2))).select("slot", "start_index", "end_index", "n_shreds", "payload_len", "last_in_slot")


def whole_slots(fragments: DataFrame) -> DataFrame:
    """(slot, last_index, payload_len, complete): all of 0..last present and the last one complete."""
    last = F.max(F.when(F.col("last_in_slot"), F.col("idx")))
    ready = fragments.groupBy("slot").agg(last.alias("last_index"), F.count("*").alias("n"), F.sum("payload_len").alias("payload_len"), F.max_by("data_complete", "idx").alias("ends"), F.max("idx").alias("top"))
    complete = (F.col("n") == F.col("last_index") + 1) & (F.col("top") == F.col("last_index")) & F.col("ends")
    return ready.select("slot", "last_index", "payload_len", F.coalesce(complete, F.lit(False)).alias("complete"))


def open_prefixes(fragments: DataFrame) -> DataFrame:
    """For each anchor (index 0, or the index after a boundary): the contiguous run from there."""
    marked = with_island(fragments)
    before = F.coalesce(F.lag("data_complete").over(Window.partitionBy("slot", "island").orderBy("idx")), F.lit(False))
    end = F.max("idx").over(Window.partitionBy("slot", "island"))
    anchors = marked.withColumn("end_index", end).withColumn("anchor", (F.col("idx") == 0) | before)
    return anchors.where("anchor").select("slot", F.col("idx").alias("anchor_index"), "end_index", (F.col("end_index") - F.col("idx") + 1).alias("run"))


def gaps(fragments: DataFrame) -> DataFrame:
    """(slot, missing): one row for each index that lies between received ones (or before the first)."""
    ahead = F.coalesce(F.lag("idx").over(_slot()), F.lit(-1))
    holes = fragments.select("slot", (ahead + 1).alias("lo"), (F.col("idx") - 1).alias("hi")).where("lo <= hi")
    return holes.select("slot", F.explode(F.sequence("lo", "hi")).alias("missing"))


def contiguous_prefix(fragments: DataFrame) -> DataFrame:
    """(slot, prefix, first_index, last_index): length of the run from index 0."""
    return with_island(fragments).groupBy("slot").agg(F.count_if(F.col("island") == -1).alias("prefix"), F.min("idx").alias("first_index"), F.max("idx").alias("last_index"))


def erasure_sets(fragments: DataFrame, width: int = 4, needed: int = 3) -> DataFrame:
    """State of each erasure set: complete, recoverable (enough present) or short."""
    state = F.when(F.col("present") >= width, "complete").when(F.col("present") >= needed, "recoverable").otherwise("short")
    return fragments.groupBy("slot", "fec_set").agg(F.count("*").alias("present"), F.min_by("sig", "arrival").alias("config")).withColumn("state", state)


def within_budget(rows: DataFrame, size: str, most_bytes: int, most_rows: int) -> DataFrame:
    """Rows of each slot in index order while neither budget is exceeded (a prefix by construction)."""
    spent = F.sum(size).over(_slot().rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("turn", F.row_number().over(_slot())).withColumn("spent", spent).where((F.col("turn") <= most_rows) & (F.col("spent") <= most_bytes))


def suffix_sum(size: str) -> Column:
    """Bytes from this fragment to the slot's end."""
    return F.sum(size).over(Window.partitionBy("slot").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def coverage(observed: DataFrame) -> DataFrame:
    """Per slot: shreds, duplicates, conflicts, datasets, contiguous prefix and missing indexes, in one pass.

    ``observed`` has all arrivals with their observation.  Islands and parts are worked out on all
    rows (an arrival that isn't accepted shares the place of the accepted one), so that everything
    stays on the slot's partitioning: no second scan, no join.
    """
    first = F.col("observation") == "Accepted"
    boundary = first & F.col("data_complete")
    so_far = F.count_if(first).over(Window.partitionBy("slot").orderBy("idx").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before = Window.partitionBy("slot", "island").orderBy("idx").rangeBetween(Window.unboundedPreceding, -1)
    marked = observed.withColumn("island", F.col("idx") - so_far).withColumn("part", F.coalesce(F.count_if(boundary).over(before), F.lit(0)))
    kind = lambda name: F.count_if(F.col("observation") == name)
    parts = marked.groupBy("slot", "island", "part").agg(F.count("*").alias("n"), kind("Duplicate").alias("dup"), kind("Conflict").alias("con"), F.count_if(first).alias("own"), F.min("idx").alias("lo"), F.max("idx").alias("hi"), F.bool_or(boundary).alias("done"))
    dataset = F.col("done") & ((F.col("part") > 0) | (F.col("lo") == 0) | (F.col("own") >= 2))
    return parts.groupBy("slot").agg(
        F.sum("n").alias("shreds"), F.sum("dup").alias("duplicates"), F.sum("con").alias("conflicts"), F.count_if(dataset).alias("datasets"), F.coalesce(F.sum(F.when(F.col("island") == -1, F.col("own"))), F.lit(0)).alias("prefix"), (F.max("hi") + 1 - F.sum("own")).alias("missing")
    )
