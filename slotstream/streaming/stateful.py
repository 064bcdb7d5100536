"""Stateful stream operators: deduplication, reassembly and the fork tracker as state processors.

They give, in arrival order, what the batch operators give in one pass; the state store keeps one
small value per key, and the query's checkpoint restores it after a restart.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from slotstream.operators import entries
from slotstream.streaming.forks import ForkTracker

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """State processors need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Json(StatefulProcessor):
    """A processor whose state of a key is one JSON value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "json string")

    def read(self, default):
        return json.loads(self.value.get()[0]) if self.value.exists() else default

    def write(self, x) -> None:
        self.value.update((json.dumps(x),))

    def close(self) -> None:
        pass


class Dedupe(StatefulProcessor):
    """Accepted, Duplicate or Conflict of each fragment of a key: once per stage, and not refreshed by duplicates.

    With ``ttl_ms`` an entry goes once the watermark on its slot has passed and it is that old (by
    the time it was last accepted): a timer on the slot asks, and asks again with each later
    watermark until the entry is old enough.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "sig string, stages string, seen bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = int(time.time() * 1000)
        signature, stages, seen = self.value.get() if self.value.exists() else (None, "", now)
        held = set(filter(None, stages.split(",")))
        pdf = pd.concat(list(rows)).sort_values("arrival")
        names = pdf["stage"] if "stage" in pdf else ["ingress"] * len(pdf)
        out, accepted = [], False
        for sig, stage in zip(pdf.sig, names, strict=True):
            signature = sig if signature is None else signature
            verdict = "Conflict" if sig != signature else "Duplicate" if stage in held else "Accepted"
            if verdict == "Accepted":
                held.add(stage)
                seen, accepted = now, True
            out.append(verdict)
        if accepted:
            self.value.update((signature, ",".join(sorted(held)), seen))
            if self.ttl_ms is not None:
                self.handle.registerTimer(int(key[0]) * 1000 + 1)
        yield pdf.assign(observation=out)[["slot", "idx", "arrival", "sig", "observation"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.value.exists():
            if time.time() * 1000 - self.value.get()[2] >= (self.ttl_ms or 0):
                self.value.clear()
            else:
                self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + 1)
        yield pd.DataFrame({"slot": [], "idx": [], "arrival": [], "sig": [], "observation": []}).astype({"slot": "int64", "idx": "int64", "arrival": "int64", "sig": str, "observation": str})

    def close(self) -> None:
        pass


class OpenPrefix(StatefulProcessor):
    """Transactions of a slot's open data set as soon as its contiguous fragments hold them whole.

    What has been given out is remembered by its number; a malformed prefix drops the slot's state
    (later fragments begin anew), a complete payload clears it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "prefix binary, next bigint, given bigint")
        self.waiting = handle.getMapState("waiting", "idx bigint", "payload binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        prefix, following, given = self.value.get() if self.value.exists() else (b"", 0, 0)
        prefix = bytes(prefix)
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples():
            if row.idx >= following and not self.waiting.containsKey((int(row.idx),)):
                self.waiting.updateValue((int(row.idx),), (bytes(row.payload),))
        out = []
        while self.waiting.containsKey((following,)):
            prefix += bytes(self.waiting.getValue((following,))[0])
            self.waiting.removeKey((following,))
            following += 1
        found, state = entries.prefix_ranges(prefix)
        if state != "Malformed":
            out = [(int(key[0]), n, a, b) for n, (a, b) in enumerate(found) if n >= given]
        if state == "Incomplete":
            self.value.update((prefix, following, len(found)))
        else:
            self.value.clear()
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["slot", "ordinal", "start", "end"])

    def close(self) -> None:
        pass


class Reassembly(_Json):
    """Datasets of a slot as their last fragment arrives: boundaries already given out are removed,
    so later ones anchor by contiguity, as long as no earlier boundary is pending."""

    tail_min = 2

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.read({"have": [], "pending": []})
        have, pending, out = set(state["have"]), set(state["pending"]), []
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples():
            if row.idx not in have:
                have.add(int(row.idx))
                if row.data_complete:
                    pending.add(int(row.idx))
            out += [(int(key[0]), a, b) for a, b in self.drain(have, pending)]
        self.write({"have": sorted(have), "pending": sorted(pending)})
        yield pd.DataFrame(out, columns=["slot", "start_index", "end_index"])

    def drain(self, have: set[int], pending: set[int]) -> list[tuple[int, int]]:
        out = []
        for end in sorted(pending):
            earlier = [b for b in pending if b < end]
            if earlier:
                start = max(earlier) + 1
                if not all(i in have for i in range(start, end + 1)):
                    continue
            else:
                start = end
                while start - 1 in have:
                    start -= 1
                if start > 0 and end - start + 1 < self.tail_min:
                    continue
            out.append((start, end))
        for start, end in out:
            pending.discard(end)
            have.difference_update(range(start, end + 1))
        return out


class Forks(_Json):
    """Slot transitions of the one fork graph (a constant key; feed it (slot, first parent) only).

    The graph is one state value of one task by its nature: each transition depends on all before.
    The tracker's window bounds it to the newest slots (a few thousand rows of two numbers), whatever
    the length of the stream; a slot arrives a few times a second.
    """

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        text = self.read(None)
        tracker = ForkTracker.load(text) if text else ForkTracker()
        out = []
        for row in pd.concat(list(rows)).sort_values("arrival").itertuples():
            parent = None if pd.isna(row.parent_slot) else int(row.parent_slot)
            out += [(int(row.arrival), s, old, new, tracker.tip) for s, old, new in tracker.observe(int(row.slot), parent)["transitions"]]
        self.write(tracker.dump())
        yield pd.DataFrame(out, columns=["arrival", "slot", "previous", "status", "tip"])


def deduped(stream: DataFrame, lag: int | None = None, ttl_ms: int = 0) -> DataFrame:
    """(slot, idx, arrival, sig, observation) of a stream of fragments, by ``stage`` if it has that column.

    With ``lag`` state is bounded: a second of event time stands for a slot, and the watermark is the
    newest slot less ``lag``.  Entries below it go once they are ``ttl_ms`` old, and fragments below
    it are late and dropped by Spark.  Without ``lag`` every key is kept.
    """
    schema = "slot bigint, idx bigint, arrival bigint, sig string, observation string"
    if lag is None:
        return stream.groupBy("slot", "idx").transformWithStateInPandas(Dedupe(), schema, "Append", "None")
    timed = stream.withColumn("slot_time", F.timestamp_seconds("slot")).withWatermark("slot_time", f"{lag} seconds")
    return timed.groupBy("slot", "idx").transformWithStateInPandas(Dedupe(ttl_ms), schema, "Append", "EventTime")


def opened(stream: DataFrame) -> DataFrame:
    """(slot, ordinal, start, end) of the transactions in open prefixes of a stream (slot, idx, arrival, payload)."""
    return stream.groupBy("slot").transformWithStateInPandas(OpenPrefix(), "slot bigint, ordinal bigint, start bigint, end bigint", "Append", "None")


def reassembled(stream: DataFrame) -> DataFrame:
    return stream.groupBy("slot").transformWithStateInPandas(Reassembly(), "slot bigint, start_index bigint, end_index bigint", "Append", "None")


def fork_transitions(stream: DataFrame) -> DataFrame:
    """Transitions of a stream (arrival, slot, parent_slot)."""
    return stream.withColumn("graph", F.lit(0)).groupBy("graph").transformWithStateInPandas(Forks(), "arrival bigint, slot bigint, previous string, status string, tip bigint", "Append", "None")
