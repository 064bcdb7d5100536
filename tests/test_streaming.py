"""Stream forms against batch forms, the fork tracker's literal cases, and the feed's recovery."""

import pytest
from slotstream.operators import dedupe
from slotstream.streaming import feed, stateful
from slotstream.streaming.forks import ForkTracker

FRAGMENT = "slot bigint, idx bigint, sig string, arrival bigint, data_complete boolean"


def test_tracker_depths():
    t = ForkTracker(confirmed_hops=1, finalized_hops=2)
    marks = []
    for slot, parent in ((10, 9), (9, 8), (11, 10)):
        t.observe(slot, parent)
        marks.append(t.watermarks)
    assert marks == [(10, None, None), (10, 9, None), (11, 10, 9)]


def test_tracker_reorg():
    t = ForkTracker()
    for slot in range(8, 13):
        t.observe(slot, slot - 1)
    found = [t.observe(13, 9), t.observe(14, 13), t.observe(15, 14)]
    last = next(x["reorg"] for x in found if x["reorg"])
    t = ForkTracker.load(t.dump())
    assert (last["old_tip"], last["common_ancestor"], last["detached"]) == (12, 9, [12, 11, 10])
    assert last["attached"] == [13, 14, 15][: len(last["attached"])] and t.tip == 15
    assert t.status[12] == "Orphaned" and t.status[15] == "Processed"


def test_tracker_window():
    t = ForkTracker(window=4)
    for slot in range(10):
        t.observe(slot, slot - 1 if slot else None)
    assert len(t.parent) <= 5 and t.tip == 9


def run(spark, frame, build, tmp_path, name):
    """Run a stateful query over the rows in two files, as two micro-batches."""
    stateful.use_rocksdb(spark)
    rows = frame.orderBy("arrival").collect()
    half = len(rows) // 2
    for part in (rows[:half], rows[half:]):
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.table(name)


def test_stream_dedupe_equals_batch(spark, tmp_path):
    rows = [(s, i % 3, "ab"[(s + i) % 5 == 0], s * 10 + i, False) for s in range(4) for i in range(7)]
    frame = spark.createDataFrame(rows, FRAGMENT)
    want = {tuple(r) for r in dedupe.observed(frame).select("slot", "idx", "arrival", "sig", "observation").collect()}
    assert {tuple(r) for r in run(spark, frame, stateful.deduped, tmp_path, "dedupe_out").collect()} == want


def test_stream_reassembly_in_arrival_order(spark, tmp_path):
    rows = [(40, 1, "a", 0, True), (12, 2, "a", 1, False), (12, 3, "a", 2, True), (40, 2, "a", 3, True), (12, 0, "a", 4, False), (12, 1, "a", 5, True), (40, 0, "a", 6, False), (10, 1, "a", 7, True)]
    got = run(spark, spark.createDataFrame(rows, FRAGMENT), stateful.reassembled, tmp_path, "reassembly_out")
    assert {tuple(r) for r in got.collect()} == {(12, 2, 3), (12, 0, 1), (40, 2, 2), (40, 0, 1)}


def test_stream_forks(spark, tmp_path):
    rows = [(k, s, p) for k, (s, p) in enumerate([(8, None), (9, 8), (10, 9), (11, 10), (12, 9), (13, 12), (14, 13)])]
    got = run(spark, spark.createDataFrame(rows, "arrival bigint, slot bigint, parent_slot bigint"), stateful.fork_transitions, tmp_path, "forks_out")
    last = {}
    for r in got.orderBy("arrival").collect():
        last[r.slot] = r.status
    assert last[11] == "Orphaned" and last[14] == "Processed"


def test_feed_replay_and_recovery(spark, tmp_path):
    log, marks = feed.FeedLog(spark, str(tmp_path / "log")), feed.Checkpoints(spark, str(tmp_path / "marks"))
    batch = lambda lo, hi, s="s1": spark.createDataFrame([(s, i, "slot_status", i, "x") for i in range(lo, hi)], feed.ENVELOPE)
    log.append(batch(0, 5), 0)
    log.append(batch(5, 8), 1)
    log.append(batch(5, 8), 1)  # a retried batch
    assert feed.recover(log, marks, "c", (1, 1)) == ("RebuildRequired", None)
    marks.store("s1", "c", 4, "{}", (1, 1), 0)
    state, tail = feed.recover(log, marks, "c", (1, 1))
    assert state == "Live" and sorted(r.sequence for r in tail.collect()) == [5, 6, 7]
    assert feed.recover(log, marks, "c", (2, 1))[0] == "RebuildRequired"
    assert log.replay("s1", 8).count() == 0
    log.append(batch(10, 12), 2)
    with pytest.raises(feed.ReplayError, match="SequenceGap"):
        log.replay("s1", 6)
    with pytest.raises(feed.ReplayError, match="SessionUnavailable"):
        log.replay("none", 0)
    log.append(batch(3, 6, "s2"), 3)
    with pytest.raises(feed.ReplayError, match="Truncated"):
        log.replay("s2", 0)
    assert feed.retained(log.read(), 2, sessions=1).count() == 2


def test_bounded_stream_dedupe(spark, tmp_path):
    """State goes below the slot floor; a duplicate is seen above it, a late fragment is dropped; stages count apart."""
    stateful.use_rocksdb(spark)
    schema = "slot bigint, idx bigint, sig string, arrival bigint, stage string"
    batches = [
        [(100, 0, "a", 0, "in"), (100, 0, "a", 1, "in"), (100, 0, "a", 2, "canon"), (101, 0, "a", 3, "in")],
        [(101, 0, "a", 4, "in"), (101, 0, "b", 5, "in"), (500, 0, "a", 6, "in")],
        [(501, 0, "a", 7, "in")],
        [(100, 0, "a", 8, "in"), (500, 0, "a", 9, "in")],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = stateful.deduped(stream, lag=64).writeStream.format("memory").queryName("bounded_dedupe").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = {r.arrival: r.observation for r in spark.table("bounded_dedupe").collect()}
    assert got == {0: "Accepted", 1: "Duplicate", 2: "Accepted", 3: "Accepted", 4: "Duplicate", 5: "Conflict", 6: "Accepted", 7: "Accepted", 9: "Duplicate"}
    assert out.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4


def test_open_prefix_gives_transactions_early(spark, tmp_path):
    from slotstream.plans.wire import synthetic_payload

    stateful.use_rocksdb(spark)
    payload = synthetic_payload(5, 4)
    parts = [payload[i : i + 200] for i in range(0, len(payload), 200)]
    rows = [(5, i, i, bytearray(p)) for i, p in enumerate(parts)]
    order = [rows[0], rows[2], rows[1], *rows[3:]]
    whole = [(5, n, *x) for n, x in enumerate(stateful.entries.ranges(payload))]
    for batch in ([order[0]], order[1:2], order[2:3], order[3:]):
        spark.createDataFrame(batch, "slot bigint, idx bigint, arrival bigint, payload binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("slot bigint, idx bigint, arrival bigint, payload binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    query = stateful.opened(stream).writeStream.foreachBatch(lambda df, _: seen.append([tuple(r) for r in df.orderBy("ordinal").collect()])).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [x for batch in seen for x in batch] == whole
    assert sum(map(len, seen[:3])) >= 2 and all(x[3] <= 600 for batch in seen[:3] for x in batch)


def test_relay_cache(spark, tmp_path):
    from slotstream.streaming.relay import SCHEMA, RelayCache

    cache = RelayCache(spark, str(tmp_path / "relay"), lag=10)
    batch = lambda *rows: spark.createDataFrame([(s, i, t, bytearray(p)) for s, i, t, p in rows], SCHEMA)
    cache.insert(batch((1, 0, 0, b"old"), (20, 0, 1, b"a"), (20, 3, 1, b"c")), 0)
    for _ in range(2):  # a batch that is tried again counts once
        cache.insert(batch((20, 0, 5, b"b"), (21, 1, 5, b"d")), 1)
    want = {(20, 0, b"b"), (20, 3, b"c"), (21, 1, b"d")}
    assert {(r.slot, r.idx, bytes(r.payload)) for r in cache.read().collect()} == want
    assert bytes(cache.highest_above(20, 1).first().payload) == b"c" and cache.exact(20, 1).count() == 0
    cache.compact(1)
    assert {(r.slot, r.idx, bytes(r.payload)) for r in cache.read().collect()} == want
    cache.insert(batch((22, 0, 9, b"e")), 2)
    assert cache.read().count() == 4
