"""Bounded caches, subscriptions, verification, records, proofs, digests and extensions by literal cases and brute force."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F
from slotstream.functions import ed25519, records
from slotstream.operators import matching, proofs, sequential, verify
from slotstream.plans import catalog, dispatch
from slotstream.streaming import extensions


def cache(**how):
    return sequential.DedupeCache(**({"ttl": 10, "lag": 64, "capacity": 100} | how))


def test_cache_keeps_recent_slots_past_their_time():
    c = cache(ttl=1)
    assert [c.observe((100, 0), "a", 0), c.observe((101, 0), "a", 2), c.observe((100, 0), "a", 3)] == ["Accepted", "Accepted", "Duplicate"]


def test_cache_drops_old_slots_past_their_time():
    c = cache(ttl=1, lag=4)
    assert [c.observe((100, 0), "a", 0), c.observe((110, 0), "a", 5), c.observe((100, 0), "a", 6)] == ["Accepted"] * 3
    assert c.evicted["expired"] == 1


def test_cache_keeps_old_slots_within_their_time():
    c = cache(ttl=100, lag=4)
    assert [c.observe((100, 0), "a", 0), c.observe((200, 0), "a", 5), c.observe((100, 0), "a", 6)] == ["Accepted", "Accepted", "Duplicate"]


def test_duplicates_do_not_refresh():
    c = cache(capacity=2)
    assert [c.observe((1, k), "a", k) for k in (0, 1)] == ["Accepted"] * 2
    assert [c.observe((1, 0), "a", 2 + k) for k in range(5)] == ["Duplicate"] * 5
    assert len(c.queue) == 2
    assert c.observe((1, 2), "a", 9) == "Accepted"  # over capacity: the first goes, though seen again since
    assert c.observe((1, 1), "a", 9) == "Duplicate" and c.observe((1, 0), "a", 9) == "Accepted"
    assert c.evicted["capacity"] >= 1


def test_conflicts_do_not_refresh_and_stages_do():
    c = cache(capacity=2)
    assert c.observe((1, 0), "a", 0) == "Accepted" and c.observe((1, 0), "b", 1) == "Conflict"
    assert c.observe((1, 0), "a", 2, "canonical") == "Accepted" and c.observe((1, 0), "a", 3, "canonical") == "Duplicate"
    assert c.observe((1, 1), "a", 4) == "Accepted" and c.observe((1, 2), "a", 5) == "Accepted"
    assert c.observe((1, 0), "a", 6, "canonical") == "Accepted"


def fold(rows, key, step):
    """Values of a fresh ``step`` for each key over the rows in order."""
    steps, out = {}, []
    for r in rows:
        out.append(steps.setdefault(key(r), step())(r))
    return out


def test_cached_observations_against_a_plain_loop(spark):
    r = random.Random(5)
    rows = [(r.randrange(3), r.randrange(40) + k // 10, r.randrange(3), r.choice("aab"), k, k, r.choice(["ingress", "canonical"])) for k in range(600)]
    frame = spark.createDataFrame(rows, "lane bigint, slot bigint, idx bigint, sig string, arrival bigint, ms bigint, stage string")
    got = {x.arrival: x.observation for x in sequential.cached_observations(frame, ["lane"], 20, 5, 30, stage="stage").collect()}

    def start():
        c = cache(ttl=20, lag=5, capacity=30)
        return lambda x: c.observe((x[1], x[2]), x[3], x[5], x[6])

    assert [got[k] for k in range(600)] == fold(rows, lambda x: x[0], start)


def test_replay_memory(spark):
    memory = sequential.RecentKeys(capacity=2, lag=10)
    assert [memory.suppressed(k, s) for k, s in (("a", 1), ("a", 1), ("b", 2), ("c", 3), ("a", 3), ("d", 50), ("c", 50))] == [False, True, False, False, False, False, False]
    r = random.Random(6)
    rows = [(k, r.randrange(4), f"k{r.randrange(30)}", k // 3) for k in range(400)]
    frame = spark.createDataFrame(rows, "seq bigint, lane bigint, key string, slot bigint")
    got = {x.seq: x.suppressed for x in sequential.replay_suppressed(frame, ["lane"], "key", "slot", "seq", 8, 40).collect()}

    def start():
        held = []  # (key, slot) in order of insertion, by the definition

        def step(x):
            seen = any(k == x[2] for k, _ in held)
            if not seen:
                held.append((x[2], x[3]))
            newest[0] = max(newest[0], x[3])
            while held and (len(held) > 8 or held[0][1] < newest[0] - 40):
                held.pop(0)
            return seen

        newest = [0]
        return step

    assert [got[k] for k in range(400)] == fold(rows, lambda x: x[1], start)


def test_any_key_suppression(spark):
    r = random.Random(7)
    rows = [(k, r.randrange(3), k * 5 + r.randrange(5), [f"k{r.randrange(6)}" for _ in range(r.randrange(1, 4))]) for k in range(400)]
    frame = spark.createDataFrame(rows, "seq bigint, lane bigint, ms bigint, keys array<string>")
    got = {x.seq: x.suppressed for x in sequential.suppressed_by_any(frame, ["lane"], "keys", "ms", "seq", 30).collect()}

    def start():
        seen = {}

        def step(x):
            hit = any(k in seen and x[2] - seen[k] <= 30 for k in x[3])
            if not hit:
                seen.update(dict.fromkeys(x[3], x[2]))
            return hit

        return step

    assert [got[k] for k in range(400)] == fold(rows, lambda x: x[1], start)


def test_folds_of_empty_frames(spark):
    frame = spark.createDataFrame([], "k bigint, seq bigint, x bigint")
    assert sequential.moving_average(frame, "k", "x", "seq").columns == ["k", "seq", "x", "ema"]
    assert sequential.bins(frame, "k", "x", "seq", 5).count() == 0


def test_wildcards_against_all_pairs(spark):
    r = random.Random(9)
    pick = lambda: r.choice([None, "a", "b"])
    events = [(k, pick(), pick(), r.choice([None, 1, 2])) for k in range(60)]
    subs = [(k, pick(), pick(), r.choice([None, None, 1, 2])) for k in range(40)]
    got = matching.matched(spark.createDataFrame(events, "e bigint, x string, y string, z int"), spark.createDataFrame(subs, "s bigint, x string, y string, z int"), ["x", "y", "z"], ["s"])
    assert got.columns == ["e", "x", "y", "z", "s"]
    want = {(e[0], s[0]) for e in events for s in subs if all(b is None or a == b for a, b in zip(e[1:], s[1:], strict=True))}
    pairs = [(x.e, x.s) for x in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want)
    assert matching.matched(got.select("e", "x"), spark.createDataFrame([], "s bigint, x string"), ["x"], ["s"]).count() == 0


def test_received_counts_matches(spark):
    r = random.Random(5)
    pick = lambda *v: r.choice(v)
    events = [(e, pick("a", "b", None, '"'), pick("a", "", None), pick(1, 2, 3, None)) for e in range(200)]
    subs = [(s % 25, pick("a", None, '"'), pick("a", "", None), pick(1, 3, None)) for s in range(40)]  # some have several
    frames = spark.createDataFrame(events, "e bigint, x string, y string, z int"), spark.createDataFrame(subs, "s bigint, x string, y string, z int")
    got = {tuple(x) for x in matching.received(*frames, ["x", "y", "z"], ["s"], "e").collect()}
    met = {}
    for e in events:
        for s in subs:
            if all(b is None or a == b for a, b in zip(e[1:], s[1:], strict=True)):
                met.setdefault(s[0], []).append(e[0])
    assert got == {(s, len(x), min(x), max(x)) for s, x in met.items()} and len(got) > 10
    assert matching.received(frames[0], frames[1].limit(0), ["x", "y", "z"], ["s"], "e").count() == 0
    assert matching.received(frames[0].limit(0), frames[1], ["x", "y", "z"], ["s"], "e").count() == 0


def test_packet_dispatch_counts_before_it_joins(spark):
    """No row for each pair of a packet and a subscription: their number grows with the product of both tables."""
    events = spark.createDataFrame([(i, i % 9, "view", i // 4) for i in range(50)], "seq bigint, source bigint, kind string, slot bigint")
    nodes = spark.range(1, 40).withColumnRenamed("id", "pubkey")
    plan = dispatch.packet_dispatch(events, nodes)._jdf.queryExecution().optimizedPlan().toString()
    join, below = plan.index("Join"), plan.rindex("Aggregate")
    assert join < plan.index("Union") < below and plan.count("Join") == 1


def test_signatures():
    """The first test vector of RFC 8032, and strict refusals."""
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = ed25519.public_key(secret)
    assert public.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signature = ed25519.sign(secret, b"")
    assert signature.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555f")
    assert ed25519.verify(public, b"", signature) and not ed25519.verify(public, b"x", signature)
    small = (1).to_bytes(32, "little")  # the neutral point as key and as half a signature
    assert not ed25519.verify(small, b"", small + bytes(32))


def made(kind="Data", slot=7, index=3, key=1, **how):
    return verify.signed(verify.packet(kind, slot, index, 0, [b"a" * 20, b"b" * 20], **how), verify.seed(key))


def test_verifier_verdicts():
    v = verify.PacketVerifier([verify.public(verify.seed(2))], retry=100)
    assert v.verify(made(), 0) == "UnknownLeader" and v.verify(made(key=2), 50) == "UnknownLeader"  # the slot waits
    assert v.verify(made(key=2), 100) == "Verified" and v.leaders[7] == verify.public(verify.seed(2))
    assert v.verify(made(key=3, index=2), 101) == "InvalidSignature"
    assert v.verify(made(key=2, index=5), 101) == "InvalidMerkle" and v.verify(made()[:1000], 101) == "Malformed"
    assert v.verify(made("Code", key=2, position=0), 101) == "Verified" and v.verify(made("Code", key=2, position=1, n_data=3), 101) == "InvalidMerkle"
    assert v.verify(b"", 0) == "Malformed" and v.verify(made(key=2) + b"tail", 102) == "Verified"
    strict = verify.PacketVerifier([verify.public(verify.seed(2))], retry=100)
    assert strict.verify(made(key=2), 0, strict=True) == "UnknownLeader" and strict.unknown == {7: 0}
    strict.set_leader(7, verify.public(verify.seed(2)))
    assert strict.verify(made(key=2), 1, strict=True) == "Verified"


def test_leaders_leave_the_window():
    v = verify.PacketVerifier(window=4)
    for slot in range(10):
        v.set_leader(slot, b"k")
    assert sorted(v.leaders) == [5, 6, 7, 8, 9]
    v.set_leader(1, b"k")
    assert 1 not in v.leaders


def test_verify_packets_keeps_leaders_of_all_slots(spark, tmp_path):
    """Leaders far below the newest slot count as well, as in the SQL."""
    keys = [*range(1, 17), 3000, 4102, 4103, 9000, 60_000]
    spark.createDataFrame([(k, 0, 1.0) for k in keys], "s_suppkey bigint, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE_SQL["verify_packets"])
    got = catalog.QUERIES["verify_packets"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    data, leaders = spark.createDataFrame([(7, 1, bytearray(made())), (99, 2, bytearray(made(slot=99)))], "k int, arrival bigint, packet binary").withColumn("ms", F.lit(1)), [(7, verify.public(verify.seed(1))), (99, verify.public(verify.seed(1)))]
    recent = verify.verified(data, spark.createDataFrame([(s, bytearray(k)) for s, k in leaders], "slot bigint, leader binary"), window=10)
    assert {r.k: r.status for r in recent.collect()} == {7: "UnknownLeader", 99: "Verified"}


def test_root_column_equals_the_packet_root(spark):
    body = verify.packet("Data", 9, 3, 0, [b"x" * 20, b"y" * 20])
    leaf = body[64 : 1203 - 40]
    frame = spark.createDataFrame([(bytearray(leaf), i, [(b"x" * 20).hex(), (b"y" * 20).hex()]) for i in (3, 4)], "leaf binary, i bigint, proof array<string>")
    got = [r[0] for r in frame.select(verify.root_column(F.col("leaf"), F.col("i"), F.col("proof"))).collect()]
    assert got == [verify.merkle_root(body, "Data", 2, False).hex(), None]


def test_records():
    payload = bytes([1, 8]) + (5).to_bytes(8, "little") + bytes([200, 0]) + bytes([2, 0x80, 0x01]) + (120).to_bytes(8, "little") + b"n" * 120
    parts = records.split(payload)
    assert [k for k, _ in parts] == [1, 200, 2] and records.decoded(*parts[0]) == ("number", 5) and records.decoded(*parts[1]) is None and records.decoded(*parts[2]) == ("name", "n" * 120)
    assert records.decoded(2, (9).to_bytes(8, "little") + b"short") is None and records.decoded(1, b"1234") is None
    with pytest.raises(EOFError):
        records.split(payload[:-1])


def test_proofs_from_chunks(spark):
    rows = [(20, 1, 0, 3, 0, "a"), (20, 2, 0, 3, 1, "x"), (20, 1, 1, 3, 2, "b"), (20, 1, 0, 3, 3, "A"), (20, 2, 1, 3, 4, "y"), (20, 1, 2, 3, 5, "c"), (20, 2, 2, 3, 6, "z"), (20, 1, 2, 3, 7, "C"), (5, 1, 0, 1, 8, "old"), (30, 1, 3, 3, 9, "bad"), (30, 1, 0, 3, 10, "q"), (40, 1, 0, 1, 11, "one")]
    got = proofs.assembled(spark.createDataFrame(rows, "slot bigint, origin bigint, place int, places int, arrival bigint, body string"), root=10, slots=100).collect()
    assert {r.slot: (r.origin, r.complete, r.body, r.ignored) for r in got} == {20: (1, 5, "Abc", 2), 40: (1, 11, "one", 0)}
    held = spark.createDataFrame([(1, 3, 10), (2, 3, 30), (3, 2, 20), (4, 1, 5)], "origin bigint, held int, stake bigint")
    assert {r.origin: r.kept for r in proofs.bounded(held, 6).collect()} == {2: 3, 3: 2, 1: 1, 4: 0}


def test_extensions(spark):
    events = spark.createDataFrame([(1, "10.0.0.1:80", None, None), (2, "10.0.0.2:80", "mine", None), (3, "10.0.0.1:80", "other", "feed")], "id bigint, local_addr string, owner_extension string, shared_tag string")
    packets = events.select("id", *[F.col(s) if s in events.columns else F.lit(None).cast("string").alias(s) for s in dispatch.SELECTORS])
    got = {}

    def collect(name):
        return lambda df, batch: got.setdefault(name, []).extend(r.id for r in df.collect())

    good = [
        extensions.Extension("ingress", collect("ingress"), ("observe_ingress",), (), [{"local_addr": "10.0.0.1:80"}, {}]),
        extensions.Extension("mine", collect("mine"), (), (), [{}]),
        extensions.Extension("shared", collect("shared"), ("observe_shared",), (), [{"shared_tag": "feed"}]),
    ]
    bad = extensions.Extension("bad", collect("bad"), ("bind_udp",), (extensions.Resource("tcp_listener", "r"), extensions.Resource("tcp_listener", "r", 0, " ")), [{"nothing": 1}])
    host = extensions.ExtensionHost([*good, bad], {"observe_ingress", "observe_shared"})
    host.sink()(packets, 0)
    assert {n: sorted(x) for n, x in got.items()} == {"ingress": [1], "mine": [2], "shared": [3]}
    assert len(host.rejected["bad"]) == 7
    with pytest.raises(ValueError):
        extensions.ExtensionHost([bad], set(), strict=True)
