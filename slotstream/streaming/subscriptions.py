"""Subscriptions as data: what a consumer wants, in which scope, and how it is fed from a stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotstream.functions import commitment

ALWAYS = ("slot_status", "reorg", "checkpoint_barrier")


@dataclass(frozen=True)
class Subscription:
    """Event kinds, least commitment and dispatch of one consumer."""

    name: str
    kinds: tuple[str, ...] = ()
    least_commitment: str = "Processed"
    only: bool = False
    scope: str = "All"
    include: tuple[int, ...] = ()
    exclude: tuple[int, ...] = ()
    required: tuple[int, ...] = ()
    critical: tuple[int, ...] = ()

    def accepts(self) -> Column:
        """Over columns kind, status, scope and keys (array of account keys)."""
        status = F.col("status")
        level = status == self.least_commitment if self.only else commitment.at_least(status, self.least_commitment)
        kind = F.col("kind").isin(*ALWAYS) | F.col("kind").isin(*self.kinds) if self.kinds else F.col("kind").isin(*ALWAYS)
        where = F.lit(True) if self.scope == "All" else F.col("scope") == self.scope
        keys = commitment.prefilter(F.col("keys"), list(self.include), list(self.exclude), list(self.required))
        return kind & level & where & (F.col("kind").isin(*ALWAYS) | keys)

    def interest(self) -> Column:
        urgent = commitment.prefilter(F.col("keys"), include=list(self.critical)) if self.critical else F.lit(False)
        return F.when(~self.accepts(), "Ignore").when(urgent, "Critical").otherwise("Background")


@dataclass
class Host:
    """Feeds every subscription from one micro-batch; what nobody wants is never built."""

    subscriptions: list[Subscription]
    callbacks: dict[str, Callable[[DataFrame, int], None]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        names = [s.name for s in self.subscriptions]
        if "" in names or len(set(names)) != len(names):
            raise ValueError("subscription names must be unique and not empty")

    def routed(self, events: DataFrame) -> DataFrame:
        """Events with the array ``subscribers`` of those that take them; events without one are gone."""
        taken = F.filter(F.array(*[F.when(s.accepts(), F.lit(s.name)) for s in self.subscriptions]), lambda x: x.isNotNull())
        return events.withColumn("subscribers", taken).where(F.size("subscribers") > 0)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: each callback gets its rows and the batch id (its key for doing a batch once)."""

        def run(batch: DataFrame, batch_id: int) -> None:
            shared = self.routed(batch).persist()
            try:
                for name, callback in self.callbacks.items():
                    callback(shared.where(F.array_contains("subscribers", name)).drop("subscribers"), batch_id)
            finally:
                shared.unpersist()

        return run


#: Batch, queue and attempts of the delivery presets.
PROFILES = {"latency_optimized": {"batch": 1, "queue": 2048, "attempts": 1}, "balanced": {"batch": 8, "queue": 8192, "attempts": 2}, "delivery_disciplined": {"batch": 32, "queue": 65536, "attempts": 4}}


def profile(name: str) -> dict[str, int]:
    """A preset by name; case, ``-`` and ``_`` don't matter."""
    return PROFILES[name.strip().lower().replace("-", "_")]


def metrics_text(frame: DataFrame, prefix: str = "slotstream") -> list[str]:
    """One exposition line per value of a one-row frame of counters."""
    row = frame.first()
    return [f"{prefix}_{n} {row[n]}" for n in frame.columns] if row else []
