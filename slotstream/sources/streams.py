"""Stream sources: replayed packet files, tagged fan-in, mode checks and resume offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PACKET = T.StructType([T.StructField("source", T.StringType()), T.StructField("observed_ms", T.LongType()), T.StructField("bytes", T.BinaryType())])
#: Which update kinds each ingress mode can deliver.
CAPABILITIES = {
    "grpc": ("transaction", "transaction_status", "account_update", "block_meta", "slot_status"),
    "websocket": ("transaction", "transaction_log", "account_update"),
    "generic": ("transaction", "transaction_log", "transaction_status", "account_update", "block_meta", "slot_status", "recent_blockhash", "cluster_topology", "leader_schedule", "reorg"),
}
#: Slots that a processed-commitment source goes back on resume.
PROCESSED_REWIND = 31


def packet_stream(spark: SparkSession, path: str, schema: T.StructType = PACKET, files_per_trigger: int = 8) -> DataFrame:
    """Recorded batches as a stream; the files a trigger may take bound a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def fan_in(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources in one frame, tagged with ``source``; names are unique by construction of the mapping."""
    if not sources:
        raise ValueError("no source")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("source", F.lit(n)) for n, f in sources.items()])


def reserve(names: list[tuple[str, str]]) -> list[str]:
    """Source names of (kind, instance) pairs; the same identity twice is an error."""
    out = [f"{k}:{i}" for k, i in names]
    if twice := {x for x in out if out.count(x) > 1}:
        raise ValueError(f"source identity reserved twice: {sorted(twice)}")
    return out


def checked(updates: DataFrame, mode: str, kind: str = "kind") -> tuple[DataFrame, DataFrame]:
    """(legal, rejected): updates whose kind the mode can deliver, and the others."""
    legal = F.coalesce(F.col(kind).isin(*CAPABILITIES[mode]), F.lit(False))
    return updates.where(legal), updates.where(~legal)


def unsupported_hooks(wanted: list[str], mode: str) -> list[str]:
    return [h for h in wanted if h not in CAPABILITIES[mode]]


def resume_slot(mode: str, tracked: Column, commitment: str = "Processed", start: int | None = None) -> Column:
    """Slot to resume from: none live; the tracked one (less a rewind if only processed); or a fixed start until one is tracked."""
    back = F.greatest(tracked - (PROCESSED_REWIND if commitment == "Processed" else 0), F.lit(0))
    if mode == "Live":
        return F.lit(None).cast("bigint")
    if mode == "Resume":
        return F.when(tracked > 0, back)
    return F.when(tracked > 0, back).otherwise(F.lit(start))


def gap_range(previous: Column, head: Column, most_slots: int) -> tuple[Column, Column]:
    """First and last slot to scan after a reconnect."""
    return F.greatest(previous, head + 1 - most_slots), head
