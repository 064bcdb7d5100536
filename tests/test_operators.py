"""Literal cases of single operators."""

import hashlib
import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from slotstream.functions import codec, commitment, ed25519, wire
from slotstream.operators import dedupe, entries, islands, recovery, sequential, tables
from slotstream.plans import wire as wire_plans

FRAGMENT = "slot bigint, idx bigint, sig string, arrival bigint, payload_len bigint, fec_set bigint, data_complete boolean, last_in_slot boolean"


def fragments(spark, *rows):
    """Rows (slot, idx, flags): c for complete, l for last."""
    return spark.createDataFrame([(s, i, "a", k, 10, 0, "c" in f or "l" in f, "l" in f) for k, (s, i, f) in enumerate(rows)], FRAGMENT)


def test_observations(spark):
    rows = [(42, 7, "A", 0), (42, 7, "A", 1), (42, 7, "B", 2), (42, 7, "A", 3), (42, 8, "B", 4)]
    frame = spark.createDataFrame(rows, "slot bigint, idx bigint, sig string, arrival bigint")
    got = [r.observation for r in dedupe.observed(frame).orderBy("arrival").collect()]
    assert got == ["Accepted", "Duplicate", "Conflict", "Duplicate", "Accepted"]


def test_two_stages_accept_once_each(spark):
    rows = [(1, 1, "A", 0, "in"), (1, 1, "A", 1, "canon"), (1, 1, "A", 2, "canon"), (1, 1, "B", 3, "canon")]
    frame = spark.createDataFrame(rows, "slot bigint, idx bigint, sig string, arrival bigint, stage string")
    got = [r.observation for r in dedupe.observed(frame, stage="stage").orderBy("arrival").collect()]
    assert got == ["Accepted", "Accepted", "Duplicate", "Conflict"]


def test_bounded_cache_keeps_recent_slots():
    cache = sequential.DedupeCache(ttl=1, lag=64, capacity=100)
    assert [cache.observe((100, 0), "a", 0), cache.observe((101, 0), "a", 2), cache.observe((100, 0), "a", 3)] == ["Accepted", "Accepted", "Duplicate"]
    assert cache.observe((300, 0), "a", 4) == "Accepted" and cache.observe((100, 0), "a", 9) == "Accepted"
    small = sequential.DedupeCache(ttl=1000, lag=64, capacity=2)
    assert [small.observe((s, 0), "a", s) for s in (1, 2, 3, 1)] == ["Accepted"] * 4


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(7, 0, ""), (7, 1, "c")], {(0, 1)}),
        ([(10, 1, "c")], set()),
        ([(12, 2, ""), (12, 3, "c"), (12, 0, ""), (12, 1, "c")], {(2, 3), (0, 1)}),
        ([(15, 5, ""), (15, 6, "c")], {(5, 6)}),
        ([(30, 1, "c"), (30, 2, ""), (30, 3, "c")], {(2, 3)}),
        ([(40, 1, "c"), (40, 2, "l"), (40, 0, "")], {(0, 1), (2, 2)}),
    ],
)
def test_datasets(spark, rows, want):
    got = {(r.start_index, r.end_index) for r in islands.datasets(fragments(spark, *rows)).collect()}
    assert got == want


def test_whole_slots(spark):
    frame = fragments(spark, (1, 0, ""), (1, 1, ""), (1, 2, "l"), (9, 0, ""), (9, 2, "l"))
    assert {(r.slot, r.last_index, r.complete) for r in islands.whole_slots(frame).collect()} == {(1, 2, True), (9, 2, False)}


def test_budgets(spark):
    frame = fragments(spark, (9, 4, ""), (9, 6, ""), (9, 5, ""))
    rows = islands.within_budget(frame.where("idx between 4 and 6"), "payload_len", 1000, 2)
    assert [r.idx for r in rows.orderBy("idx").collect()] == [4, 5]
    assert [r.idx for r in islands.within_budget(frame, "payload_len", 10, 9).collect()] == [4]
    assert sequential.within_byte_budget([5, 7, 4, 1], 10) == [True, False, True, True]


def test_time_to_live_is_not_refreshed(spark):
    frame = spark.createDataFrame([("x", 0, 0), ("x", 1, 5), ("x", 2, 30), ("x", 3, 40), ("x", 4, 55)], "k string, seq bigint, ms bigint")
    got = [r.fresh for r in sequential.expiring(frame, "k", "ms", 25).orderBy("seq").collect()]
    assert got == [True, False, True, False, True]


def test_promotion(spark):
    rows = [(0, "A", 100, "k"), (1, "B", 300, "k"), (2, "A", 100, "k"), (3, "B", 300, "k")]
    frame = spark.createDataFrame(rows, "seq bigint, source string, priority bigint, logical_key string")
    emitted = lambda mode: [r.emitted for r in dedupe.promoted(frame, "logical_key", "source", "priority", "seq", mode).orderBy("seq").collect()]
    assert emitted("promote") == [True, True, False, False]
    assert emitted("first_seen") == [True, False, False, False]
    assert emitted("emit_all") == [True, True, False, False]


def test_commitment(spark):
    frame = spark.createDataFrame([(100, 120, 150), (120, 119, 110), (5, None, None)], "slot bigint, c bigint, f bigint")
    got = [r[0] for r in frame.select(commitment.from_slot(F.col("slot"), F.col("c"), F.col("f"))).collect()]
    assert got == ["Finalized", "Processed", "Processed"]


def test_quality_ladder(spark):
    rows = [("Fresh", "Fresh", 2, 10, 10, 10), ("Fresh", "Stale", 2, 10, 10, 10), ("Missing", "Stale", 2, 10, 10, 10), ("Fresh", "Fresh", 40, 10, 10, 10), ("Fresh", "Fresh", 2, 10, 10, 9), ("Fresh", "Fresh", 2, 10, 9, 9)]
    frame = spark.createDataFrame(rows, "a string, b string, s bigint, tip bigint, c bigint, f bigint")
    got = [r[0] for r in frame.select(commitment.quality([F.col("a"), F.col("b")], F.col("s"), 32, F.col("tip"), F.col("c"), F.col("f"))).collect()]
    assert got == ["Stable", "Stale", "IncompleteControlPlane", "Degraded", "Provisional", "ReorgRisk"]


def test_diff_and_replay(spark):
    old = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "k bigint, v bigint")
    new = spark.createDataFrame([(2, 5), (3, None), (4, 1)], "k bigint, v bigint")
    assert {tuple(r) for r in tables.diff(old, new, "k").collect()} == {(1, "removed"), (2, "updated"), (4, "added")}


def test_header_errors(spark):
    zero = bytearray(1203)
    bad, short = bytes(zero), bytes(50)
    zero[64], zero[86], zero[85] = 0x92, 88, 0xC1
    zero[65:73], zero[83] = (9).to_bytes(8, "little"), 2
    good = bytes(zero)
    frame = spark.createDataFrame([(0, bytearray(bad)), (1, bytearray(short)), (2, bytearray(good)), (3, bytearray(good[:1000]))], "i int, packet binary")
    got = {r.i: r for r in frame.select("i", *[c.alias(n) for n, c in wire.header(F.col("packet")).items()]).collect()}
    assert [got[i].error for i in range(4)] == ["unknown_variant", "too_short", None, "short_data"]
    assert (got[2].slot, got[2].parent_slot, got[2].tick, got[2].data_complete, got[2].last_in_slot) == (9, 7, 1, True, True)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 65535))
def test_codecs_round_trip(raw, n):
    assert codec.base58_decode(codec.base58_encode(raw)) == raw
    assert codec.compact_length(codec.compact_bytes(n) + b"x", 0) == (n, len(codec.compact_bytes(n)))


def test_codec_errors():
    with pytest.raises(ValueError):
        codec.base58_decode("0")
    with pytest.raises(ValueError):
        codec.base58_decode("11", size=32)
    with pytest.raises(EOFError):
        codec.compact_length(b"\x80", 0)
    assert codec.runs_to_slots(10, [(0, 2), (3, 1)], least=11) == [11, 15]


def test_entry_streams():
    payload = wire_plans.synthetic_payload(5, 3)
    found = entries.ranges(payload)
    assert len(found) == 3 and found[0][0] == 56 and found[-1][1] == len(payload)
    assert entries.prefix_ranges(payload[:-1]) == (found[:2], "Incomplete")
    assert entries.prefix_ranges(payload + b"x") == (found, "Malformed")
    parts = [b"\xff" * 9, payload[:70], payload[70:]]
    assert entries.from_fragments(parts)[2] == 1 and entries.from_fragments([b"junk"]) is None


def test_erasure_codes_recover_every_pattern():
    r = random.Random(2)
    data = [bytes(r.randrange(256) for _ in range(20)) for _ in range(5)]
    every = dict(enumerate(data + recovery.encode(data, 3)))
    for lost in itertools.combinations(range(8), 3):
        back = recovery.reconstruct({i: x for i, x in every.items() if i not in lost}, 5, 3)
        assert back == {i: data[i] for i in lost if i < 5}
    assert recovery.reconstruct({0: data[0]}, 5, 3) == {}


def test_signature_vectors():
    # RFC 8032, section 7.1, tests 1 and 2.
    cases = [
        ("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
        ("3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ]
    for public, message, signature in cases:
        raw = [bytes.fromhex(x) for x in (public, message, signature)]
        assert ed25519.verify(*raw)
        assert not ed25519.verify(raw[0], raw[1] + b"x", raw[2]) and not ed25519.verify(raw[0], raw[1], raw[2][:-1])
    assert hashlib.sha512(b"").digest_size == 64


@pytest.mark.parametrize("width", [1, 4, 4096])
def test_fork_index_against_a_walk(spark, width):
    """Depths, roots and chains of a random forest, some parents unknown, some with a greater number."""
    from slotstream.operators import forks

    r = random.Random(11)
    numbers = sorted(r.sample(range(200), 90))
    order = [*numbers[1::9], *[n for n in numbers if n not in numbers[1::9]]]  # some parents come later in number
    parent = {s: (r.choice(order[max(0, k - 6) : k]) if k and r.random() < 0.93 else None) for k, s in enumerate(order)}
    rows = [(s, p if p is not None else r.choice([None, 999])) for s, p in parent.items()]
    index = forks.Index(spark.createDataFrame(rows, "slot bigint, parent_slot bigint"), width)

    def walk(s):
        out = [s]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out

    got = {x.slot: (x.parent, x.depth, x.root) for x in index.depth.collect()}
    assert got == {s: (parent[s], len(walk(s)) - 1, walk(s)[-1]) for s in parent}
    for s in r.sample(numbers, 3) + [max(parent, key=lambda s: len(walk(s)))]:
        chain = [x.slot for x in index.chain(spark.createDataFrame([(s,)], "slot bigint")).collect()]
        assert sorted(chain) == sorted(walk(s))
