"""The relay cache: recent fragments upserted from a stream, for range and exact queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "slot bigint, idx bigint, observed_ms bigint, payload binary"


class RelayCache:
    """Fragments as Parquet under ``path``, one folder per micro-batch; a retried batch overwrites its own.

    The newest observation of (slot, idx) counts, and slots more than ``lag`` below the newest
    don't.  :meth:`compact` writes the live rows as one new folder and drops those it replaces.
    """

    def __init__(self, spark: SparkSession, path: str, lag: int = 512):
        self.spark, self.path, self.lag = spark, path, lag

    def insert(self, batch: DataFrame, batch_id: int) -> None:
        rows = batch.selectExpr(*[f"cast({n.split()[0]} as {n.split()[1]}) {n.split()[0]}" for n in SCHEMA.split(", ")])
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""
        return self.insert

    def _all(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA + ", batch bigint").parquet(self.path)

    def read(self) -> DataFrame:
        rows = self._all()
        floor = F.broadcast(rows.agg((F.max("slot") - self.lag).alias("floor")))
        live = rows.join(floor, F.col("slot") >= F.col("floor"))
        return live.groupBy("slot", "idx").agg(F.max_by(F.struct("observed_ms", "payload"), F.struct("observed_ms", "batch")).alias("r")).select("slot", "idx", "r.*")

    def exact(self, slot: int, idx: int) -> DataFrame:
        return self.read().where((F.col("slot") == slot) & (F.col("idx") == idx))

    def highest_above(self, slot: int, idx: int) -> DataFrame:
        """The fragment of the greatest index from ``idx`` on."""
        return self.read().where((F.col("slot") == slot) & (F.col("idx") >= idx)).orderBy(F.desc("idx")).limit(1)

    def compact(self, batch_id: int) -> None:
        """All batches up to ``batch_id`` as that one batch; nothing is lost if it stops half-way."""
        hadoop, jvm = self.spark._jsc.hadoopConfiguration(), self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(hadoop)
        self.read().where(F.lit(True)).write.mode("overwrite").parquet(f"{self.path}/_next")
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        old = [n for n in names if n.startswith("batch=") and int(n[6:]) <= batch_id]
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={batch_id}")
        parked = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_old")
        if fs.exists(target):
            fs.rename(target, parked)
        fs.rename(jvm.org.apache.hadoop.fs.Path(f"{self.path}/_next"), target)
        fs.delete(parked, True)
        for n in old:
            if int(n[6:]) != batch_id:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}"), True)
