"""Connected components of an edge table, with joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotstream.llm import base

#: Rounds after which the loop gives up; each round at least halves the depth, so this never binds.
MAX_ROUNDS = 64


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each end of an edge (a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps: each node links its greater, then its smaller
    neighbours to the smallest id around it, until nothing changes.  Every step aggregates by
    node and joins back, so no neighbourhood is gathered in one row.
    """
    now = base.written(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(MAX_ROUNDS):
        if not mark[0]:
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = base.written(small.where("u <> v").distinct(), "edges")
        before, mark = mark, _mark(now)
        if before == mark:
            break
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]
