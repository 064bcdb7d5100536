"""The ordered, replayable feed: an append-only table per session, checkpoints, replay and recovery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENVELOPE = T.StructType([T.StructField(n, t) for n, t in (("session", T.StringType()), ("sequence", T.LongType()), ("kind", T.StringType()), ("slot", T.LongType()), ("payload", T.StringType()))])
CHECKPOINT = "session string, consumer string, last_applied bigint, state_version int, extension_version int, state string, batch bigint"


class ReplayError(Exception):
    """``reason``: SessionUnavailable, Truncated or SequenceGap."""

    def __init__(self, reason: str):
        super().__init__(reason)
        self.reason = reason


class FeedLog:
    """Envelopes as Parquet under ``path``, one folder per session and batch.

    A batch's folder is overwritten when the batch is written again, so a retried micro-batch
    leaves one copy.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, batch: DataFrame, batch_id: int) -> None:
        batch.select(*[f.name for f in ENVELOPE.fields]).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session", "batch").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(T.StructType([*ENVELOPE.fields, T.StructField("batch", T.LongType())])).parquet(self.path).drop("batch")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return self.append

    def replay(self, session: str, next_sequence: int) -> DataFrame:
        """The contiguous tail from ``next_sequence`` on; empty if that is the head."""
        own = self.read().where(F.col("session") == session)
        known = own.agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), F.count("*").alias("n"), F.countDistinct("sequence").alias("d")).first()
        if known.lo is None:
            raise ReplayError("SessionUnavailable")
        if next_sequence < known.lo:
            raise ReplayError("Truncated")
        tail = own.where(F.col("sequence") >= next_sequence)
        count = tail.select("sequence").distinct().count()
        if count != max(0, known.hi - next_sequence + 1):
            raise ReplayError("SequenceGap")
        return tail.dropDuplicates(["sequence"])


def retained(log: DataFrame, newest: int, sessions: int | None = None) -> DataFrame:
    """The newest envelopes of each session, and of the newest sessions only."""
    age = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("sequence")))
    kept = log.withColumn("age", age).where(F.col("age") <= newest).drop("age")
    if sessions is None:
        return kept
    names = log.select("session").distinct().orderBy(F.desc("session")).limit(sessions)
    return kept.join(F.broadcast(names), "session", "left_semi")


class Checkpoints:
    """Consumer checkpoints; one is used only if both versions agree."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def store(self, session: str, consumer: str, last_applied: int, state: str, versions: tuple[int, int], batch: int) -> None:
        row = [(session, consumer, last_applied, *versions, state, batch)]
        self.spark.createDataFrame(row, CHECKPOINT).coalesce(1).write.mode("append").parquet(self.path)

    def load(self, consumer: str, versions: tuple[int, int]):
        """The newest compatible checkpoint, or None."""
        try:
            table = self.spark.read.schema(CHECKPOINT).parquet(self.path)
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        own = table.where((F.col("consumer") == consumer) & (F.col("state_version") == versions[0]) & (F.col("extension_version") == versions[1]))
        return own.orderBy(F.desc("last_applied")).first()


def recover(log: FeedLog, checkpoints: Checkpoints, consumer: str, versions: tuple[int, int]) -> tuple[str, DataFrame | None]:
    """(Live, tail to apply), or (RebuildRequired, None) without a usable checkpoint or tail."""
    last = checkpoints.load(consumer, versions)
    if last is None:
        return "RebuildRequired", None
    try:
        return "Live", log.replay(last.session, last.last_applied + 1)
    except ReplayError:
        return "RebuildRequired", None
