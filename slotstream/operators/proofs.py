"""Duplicate-slot proofs: assembled from chunks, and the bounded buffer that holds incomplete ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most chunks of a proof; more, or a place beyond the count, is an error.
MOST_CHUNKS = 3


def assembled(chunks: DataFrame, root: int, slots: int) -> DataFrame:
    """(slot, origin, complete, body, ignored): the proof of each slot, by its first complete origin.

    ``chunks``: slot, origin, place, places, arrival, body.  Only slots above the root and within
    ``slots`` of it are taken; a proof is complete when every place has arrived, with the last body
    of each place until then; ``ignored`` counts the slot's later chunks.
    """
    taken = chunks.where((F.col("slot") > root) & (F.col("slot") < root + slots) & (F.col("place") < F.col("places")) & (F.col("places") <= MOST_CHUNKS))
    first = taken.groupBy("slot", "origin", "place").agg(F.min("arrival").alias("first"), F.max("places").alias("places"))
    done = first.groupBy("slot", "origin").agg(F.max("first").alias("complete"), F.count("*").alias("have"), F.max("places").alias("places")).where("have = places")
    winner = done.groupBy("slot").agg(F.min(F.struct("complete", "origin")).alias("w")).select("slot", F.col("w.origin").alias("winner"), F.col("w.complete").alias("complete"))
    met = taken.join(winner, "slot")
    own = (F.col("origin") == F.col("winner")) & (F.col("arrival") <= F.col("complete"))
    last = met.groupBy("slot", "winner", "complete", "place").agg(F.max_by(F.when(own, F.col("body")), F.when(own, F.col("arrival"))).alias("body"), F.count_if(F.col("arrival") > F.col("complete")).alias("late"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "body"))), lambda x: x["body"]), "")
    return last.groupBy("slot", F.col("winner").alias("origin"), "complete").agg(body.alias("body"), F.sum("late").alias("ignored"))


def bounded(held: DataFrame, capacity: int) -> DataFrame:
    """(origin, held, stake) with ``kept``: entries of the greatest stakes stay while the buffer has room.

    Only origins that can be among the first ``capacity`` are ordered in one place: each holds one entry at least.
    """
    front = held.orderBy(F.desc("stake"), "origin").limit(capacity)
    before = F.coalesce(F.sum("held").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("stake"), "origin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = front.select("origin", F.greatest(F.lit(0), F.least("held", F.lit(capacity) - before)).cast("bigint").alias("kept"))
    return held.join(F.broadcast(kept), "origin", "left").withColumn("kept", F.coalesce("kept", F.lit(0)).cast("bigint"))
