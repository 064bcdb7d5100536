"""Operators whose decisions depend on earlier decisions: folded in order, one small state at a time.

Rows are dealt by key and sorted within partitions (which spills), then stream through Arrow batches;
only the state of the key at hand is held, so that a key may have any number of rows.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64(), "binary": pa.binary()}


def in_order(frame: DataFrame, keys: list[str], order: list[str], start: Callable[[], Callable], inputs: list[str], added: str) -> DataFrame:
    """``frame`` with the columns ``added`` (DDL) that a fold over each key's rows in ``order`` gives.

    ``start()`` returns a fresh step for a new key; the step takes the row's ``inputs`` and returns
    the value (or, for several added columns, the tuple of values) of that row.
    """
    new = T.StructType.fromDDL(added)
    keep = [c for c in frame.columns if c not in new.names]
    schema = T.StructType([frame.schema[c] for c in keep] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = object(), None
        for b in batches:
            out = []
            rows = zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in (*keys, *inputs)], strict=True)
            for row in rows:
                key = row[: len(keys)]
                if key != now:
                    now, step = key, start()
                value = step(*row[len(keys) :])
                out.append(value if len(new) > 1 else (value,))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in new]
            arrays = [b.column(b.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(list(v), _ARROW[f.dataType.simpleString()]) for v, f in zip(columns, new.fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *new.names])

    return frame.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


class DedupeCache:
    """Keyed observations with conflict detection and bounded retention.

    An identity is accepted once per stage; another signature for it is a conflict.  Only accepted
    observations set an entry's time and queue it for eviction: neither duplicates nor conflicts
    refresh it.  From the front of the queue an entry leaves once it is ``ttl`` old and its slot lies
    more than ``lag`` below the newest, or while there are more than ``capacity`` entries; a queued
    observation that a later one has overtaken is passed over.
    """

    def __init__(self, ttl: int, lag: int, capacity: int):
        self.ttl, self.lag, self.capacity = ttl, max(1, lag), capacity
        self.entries: dict[tuple, list] = {}
        self.queue: deque[tuple[int, tuple]] = deque()
        self.newest = 0
        self.evicted = {"expired": 0, "capacity": 0}

    def observe(self, key: tuple, signature: str, now: int, stage: str = "ingress") -> str:
        self.newest = max(self.newest, key[0])
        self._evict(now)
        entry = self.entries.get(key)
        if entry is None:
            self.entries[key] = [signature, {stage}, now]
            self.queue.append((now, key))
            self._evict(now)
            return "Accepted"
        if entry[0] != signature:
            return "Conflict"
        if stage in entry[1]:
            return "Duplicate"
        entry[1].add(stage)
        entry[2] = now
        self.queue.append((now, key))
        return "Accepted"

    def _evict(self, now: int) -> None:
        floor = max(0, self.newest - self.lag)
        while self.queue:
            seen, key = self.queue[0]
            expired = now - seen >= self.ttl and key[0] < floor
            if not expired and len(self.entries) <= self.capacity:
                return
            self.queue.popleft()
            entry = self.entries.get(key)
            if entry is not None and entry[2] == seen:
                del self.entries[key]
                self.evicted["expired" if expired else "capacity"] += 1


def cached_observations(frame: DataFrame, lane: list[str], ttl: int, lag: int, capacity: int, key: tuple[str, ...] = ("slot", "idx"), signature: str = "sig", time: str = "ms", stage: str | None = None, order: tuple[str, ...] = ("arrival",)) -> DataFrame:
    """Adds ``observation`` as a bounded cache of each ``lane`` decides it, in order of arrival."""

    def start() -> Callable:
        cache = DedupeCache(ttl, lag, capacity)
        return lambda *row: cache.observe(tuple(row[: len(key)]), row[len(key)], row[len(key) + 1], row[len(key) + 2] if stage else "ingress")

    return in_order(frame, lane, list(order), start, [*key, signature, time, *([stage] if stage else [])], "observation string")


class RecentKeys:
    """Replay suppression by logical key: bounded by ``capacity`` and by ``lag`` slots below the newest.

    Keys leave from the front of the insertion order; a key without a slot leaves by capacity only.
    """

    def __init__(self, capacity: int, lag: int):
        self.capacity, self.lag, self.newest = capacity, lag, 0
        self.keys: OrderedDict[str, int | None] = OrderedDict()

    def suppressed(self, key: str, slot: int | None) -> bool:
        self.newest = max(self.newest, slot or 0)
        seen = key in self.keys
        if not seen:
            self.keys[key] = slot
        while self.keys:
            slot = next(iter(self.keys.values()))
            if len(self.keys) <= self.capacity and (slot is None or slot >= self.newest - self.lag):
                break
            self.keys.popitem(last=False)
        return seen


def replay_suppressed(frame: DataFrame, lane: list[str], key: str, slot: str, order: str, capacity: int = 65_536, lag: int = 4_096) -> DataFrame:
    """Adds ``suppressed``: the lane's bounded memory still holds the row's logical key."""

    def start() -> Callable:
        memory = RecentKeys(capacity, lag)
        return memory.suppressed

    return in_order(frame, lane, [order], start, [key, slot], "suppressed boolean")


class Suppression:
    """Suppression by any of several keys; an insert refreshes all of them, a key dies strictly after ``ttl``."""

    def __init__(self, ttl: int):
        self.ttl, self.seen = ttl, OrderedDict()

    def take(self, keys: list[str], now: int) -> bool:
        """True if any key is alive; otherwise all are (re)inserted."""
        while self.seen and now - next(iter(self.seen.values())) > self.ttl:
            self.seen.popitem(last=False)
        if any(k in self.seen and now - self.seen[k] <= self.ttl for k in keys):
            return True
        for k in keys:
            self.seen[k] = now
            self.seen.move_to_end(k)
        return False


def suppressed_by_any(frame: DataFrame, lane: list[str], keys: str, time: str, order: str, ttl: int) -> DataFrame:
    """Adds ``suppressed`` for the array of keys of each row, per lane."""

    def start() -> Callable:
        return Suppression(ttl).take

    return in_order(frame, lane, [order], start, [keys, time], "suppressed boolean")


def expiring(frame: DataFrame, key: str, time: str, ttl: int, order: str = "seq") -> DataFrame:
    """Adds ``fresh``: no accepted row of the key less than ``ttl`` before; the time runs from the last accepted row."""

    def start() -> Callable:
        last = [None]

        def step(now: int) -> bool:
            fresh = last[0] is None or now - last[0] >= ttl
            if fresh:
                last[0] = now
            return fresh

        return step

    return in_order(frame, [key], [time, order], start, [time], "fresh boolean")


def moving_average(frame: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Adds ``ema``: the integer average (7 old + new) / 8, rounded down, that starts at the first value."""

    def start() -> Callable:
        state = [None]

        def step(x: int) -> int:
            state[0] = x if state[0] is None else (7 * state[0] + x) // 8
            return state[0]

        return step

    return in_order(frame, [key], [order], start, [value], "ema bigint")


def halving_score(frame: DataFrame, key: str, period: str, amount: str, order: str) -> DataFrame:
    """Adds ``score``: counters halved (rounded down) once for each period that passes, then added to."""

    def start() -> Callable:
        state = [None, 0]

        def step(now: int, x: int) -> int:
            if state[0] is not None:
                state[1] >>= min(63, now - state[0])
            state[0], state[1] = now, state[1] + x
            return state[1]

        return step

    return in_order(frame, [key], [period, order], start, [period, amount], "score bigint")


def bins(frame: DataFrame, key: str, size: str, order: str, most: int) -> DataFrame:
    """Adds ``bin``: messages of a key fill chunks of ``most`` bytes in turn; larger ones are dropped (null)."""

    def start() -> Callable:
        state = [0, 0]

        def step(n: int) -> int | None:
            if n > most:
                return None
            if state[1] + n > most:
                state[0], state[1] = state[0] + 1, 0
            state[1] += n
            return state[0]

        return step

    return in_order(frame, [key], [order], start, [size], "bin bigint")


def within_byte_budget(sizes: list[int], most: int) -> list[bool]:
    """Which requests pass a byte budget: rejected ones use nothing up."""
    left, out = most, []
    for n in sizes:
        out.append(n <= left)
        left -= n if out[-1] else 0
    return out


def byte_budgets(requests: DataFrame, key: str, window: str, size: str, order: str, most: int) -> DataFrame:
    """Adds ``served``: the request fits what is left of its (key, window) byte budget."""

    def start() -> Callable:
        left = [most]

        def step(n: int) -> bool:
            served = n <= left[0]
            left[0] -= n if served else 0
            return served

        return step

    return in_order(requests, [key, window], [order], start, [size], "served boolean")
