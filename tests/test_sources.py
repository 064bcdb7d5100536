"""Sources, fan-in, mode checks and subscriptions."""

import pytest
from pyspark.sql import functions as F
from slotstream.sources import streams
from slotstream.streaming import subscriptions as subs


def test_fan_in_and_modes(spark):
    a = spark.createDataFrame([(1, "transaction"), (2, "block_meta"), (3, None)], "slot bigint, kind string")
    both = streams.fan_in({"a": a, "b": a.where("slot = 1")})
    assert sorted((r.source, r.slot) for r in both.collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    legal, rejected = streams.checked(a, "websocket")
    assert [r.slot for r in legal.collect()] == [1] and sorted(r.slot for r in rejected.collect()) == [2, 3]
    assert streams.unsupported_hooks(["transaction", "reorg"], "grpc") == ["reorg"]
    with pytest.raises(ValueError):
        streams.reserve([("grpc", "x"), ("grpc", "x")])


def test_resume(spark):
    frame = spark.createDataFrame([(0,), (10,), (100,)], "t bigint")
    got = [tuple(r) for r in frame.select(streams.resume_slot("Resume", F.col("t")), streams.resume_slot("FromSlot", F.col("t"), start=7), streams.resume_slot("Resume", F.col("t"), "Confirmed"), streams.resume_slot("Live", F.col("t"))).collect()]
    assert got == [(None, 7, None, None), (0, 0, 10, None), (69, 69, 100, None)]


def test_packet_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([("s", k, bytearray(b"x"))], streams.PACKET).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    query = streams.packet_stream(spark, str(tmp_path / "in"), files_per_trigger=1).writeStream.foreachBatch(lambda df, i: seen.append(df.count())).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(seen) == 3 and len(seen) == 3


def test_subscriptions(spark):
    rows = [(1, "transaction", "Processed", "inline", [1, 2]), (2, "transaction", "Finalized", "inline", [3]), (3, "slot_status", "Processed", "inline", []), (4, "account", "Confirmed", "deferred", [1, 9])]
    events = spark.createDataFrame(rows, "id bigint, kind string, status string, scope string, keys array<bigint>")
    host = subs.Host([subs.Subscription("a", ("transaction", "account"), include=(1,), exclude=(2,)), subs.Subscription("b", ("transaction",), "Confirmed"), subs.Subscription("c", ("transaction",), "Processed", only=True)])
    assert {r.id: r.subscribers for r in host.routed(events).collect()} == {1: ["c"], 2: ["b"], 3: ["a", "c"], 4: ["a"]}
    got = {}
    host.callbacks = {"b": lambda df, i: got.update({i: [r.id for r in df.collect()]})}
    host.sink()(events, 5)
    assert got == {5: [2]}
    with pytest.raises(ValueError):
        subs.Host([subs.Subscription("a"), subs.Subscription("a")])
    assert subs.profile(" Latency-Optimized ")["attempts"] == 1
    assert subs.metrics_text(events.agg(F.count("*").alias("events"))) == ["slotstream_events 4"]


def wait(check, seconds=10):
    import time

    end = time.time() + seconds
    while not check() and time.time() < end:
        time.sleep(0.05)
    assert check()


def test_socket_spool_feeds_a_stream(spark, tmp_path):
    import socket
    import struct

    from slotstream.sources import spool, streams

    box = spool.Spool(str(tmp_path / "spool"), batch=4, linger=0.02)
    writer = box.start()
    udp, tcp = spool.udp_listener(box), spool.tcp_listener(box)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as out:
        for k in range(10):
            out.sendto(b"u%d" % k, udp.address)
    with socket.create_connection(tcp.address) as out:
        for k in range(5):
            body = b"t%d" % k * 50
            out.sendall(struct.pack(">I", len(body)) + body)
    import glob

    import pyarrow.parquet as pq

    total = lambda: sum(pq.read_metadata(f).num_rows for f in glob.glob(str(tmp_path / "spool" / "[0-9]*.parquet")))
    wait(lambda: total() == 15)
    udp.close()
    tcp.close()
    box.stop()
    writer.join(5)
    stream = streams.packet_stream(spark, str(tmp_path / "spool"))
    query = stream.writeStream.format("memory").queryName("spooled").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(bytes(r["bytes"]) for r in spark.table("spooled").collect())
    assert got == sorted([b"u%d" % k for k in range(10)] + [b"t%d" % k * 50 for k in range(5)])


def test_spool_overflow(tmp_path):
    import pyarrow.parquet as pq
    from slotstream.sources import spool

    for mode, want in (("drop_newest", [b"0", b"1", b"2"]), ("overwrite_oldest", [b"2", b"3", b"4"])):
        box = spool.Spool(str(tmp_path / mode), capacity=3, overflow=mode)
        box.push([("s", b"%d" % k) for k in range(5)])
        assert box.dropped == 2 and box.flush() == 3 and box.flush() == 0
        (name,) = (tmp_path / mode).iterdir()
        assert pq.read_table(name).column("bytes").to_pylist() == want


def test_node_dump_and_restore(spark, tmp_path):
    from slotstream.sources import nodes

    path = str(tmp_path / "nodes")
    assert nodes.restore(spark, path) is None
    for k in range(4):
        nodes.save(spark.range(k + 1), path)
    (tmp_path / "nodes" / "v=9999999999999999999").mkdir()  # a dump that never became whole
    assert nodes.restore(spark, path).count() == 4 and len(list((tmp_path / "nodes").iterdir())) == 3
