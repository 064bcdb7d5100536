"""Queries over gossip messages: bins, typed records, the retention matrix, digests and proof chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotstream.functions import records
from slotstream.operators import dedupe, digests, proofs, sequential
from slotstream.plans.registry import query

DAY = 86_400_000


@query("""WITH e AS (SELECT source, seq, octet_length(encode(props)) + CAST(floor(value) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY seq) AS k FROM v_event WHERE octet_length(encode(props)) + CAST(floor(value) AS BIGINT) <= 100),
r(source, seq, k, bin, used) AS (SELECT source, seq, k, CAST(0 AS BIGINT), size FROM e WHERE k = 1 UNION ALL SELECT e.source, e.seq, e.k, CASE WHEN used + e.size > 100 THEN bin + 1 ELSE bin END, CASE WHEN used + e.size > 100 THEN e.size ELSE used + e.size END FROM r JOIN e ON e.source = r.source AND e.k = r.k + 1)
SELECT source, seq, bin FROM r""", recursive=True)
def message_bins(v_event):
    """A source's messages filled greedily into chunks of at most 100 bytes; larger ones are dropped."""
    rows = v_event.select("source", "seq", (F.octet_length("props") + F.floor("value").cast("bigint")).alias("size"))
    return sequential.bins(rows, "source", "size", "seq", 100).where("bin is not null").select("source", "seq", "bin")


@query("""SELECT seq, CASE WHEN source % 5 > 0 THEN seq END AS number, kind AS name, CASE WHEN source % 5 = 0 THEN 2 ELSE 1 END + CASE WHEN source % 3 = 0 THEN 1 ELSE 0 END AS ignored FROM v_event""")
def typed_records(v_event):
    """Type-length-value records: known types decode, unknown types and malformed values are passed over."""
    number = F.when(F.col("source") % 5 == 0, records.record(1, records.u32(F.col("seq")))).otherwise(records.record(1, records.u64(F.col("seq"))))
    named = records.record(2, records.text(F.col("kind")))
    other = F.when(F.col("source") % 3 == 0, records.record(9, F.encode("props", "UTF-8"))).otherwise(F.unhex(F.lit("")))
    payload = F.concat(records.record(7, F.unhex(F.lit("00"))), number, named, other)
    return records.parsed(v_event.select("seq", payload.alias("payload")), "payload").select("seq", "number", "name", "ignored")


#: What is retained on the way in, on push and on pull response; S: only of staked origins.
RETENTION = {
    "ContactInfo": "YYY", "SnapshotHashes": "YYY", "DuplicateShred": "SSS", "LowestSlot": "SSS", "RestartHeaviestFork": "SSS", "RestartLastVotedForkSlots": "SSS", "EpochSlots": "YSS", "Vote": "YYS",
    "AccountsHashes": "NNN", "LegacyContactInfo": "NNN", "LegacySnapshotHashes": "NNN", "LegacyVersion": "NNN", "OldLowestSlot": "NNN", "NodeInstance": "NNN", "Version": "NNN",
}
DIRECTIONS = ["Ingress", "EgressPush", "EgressPullResponse"]
#: Fixed value: with fewer staked nodes than this, stakes don't count.
LEAST_STAKED = 500
_KINDS = list(RETENTION)
_RULES = " ".join(f"WHEN '{k}/{d}' THEN '{RETENTION[k][i]}'" for k in _KINDS for i, d in enumerate(DIRECTIONS))


@query(f"""WITH n AS (SELECT count(*) AS staked FROM v_node WHERE stake > 0), k AS (SELECT ordinal, pubkey, CASE ordinal % {len(_KINDS)} {' '.join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS))} END AS kind, CASE pubkey % 3 WHEN 0 THEN 'Ingress' WHEN 1 THEN 'EgressPush' ELSE 'EgressPullResponse' END AS direction FROM v_gossip)
SELECT ordinal, kind, direction, CASE CASE concat(kind, '/', direction) {_RULES} END WHEN 'Y' THEN true WHEN 'N' THEN false ELSE staked < {LEAST_STAKED} OR coalesce(stake, 0) >= 1000 END AS retained FROM k LEFT JOIN v_node USING (pubkey), n""")
def retention_matrix(v_gossip, v_node):
    """Whether a value is retained, by kind, direction and its origin's stake (once enough nodes are staked)."""
    pick = lambda names, i: F.element_at(F.array(*[F.lit(x) for x in names]), (i + 1).cast("int"))
    rows = v_gossip.select("ordinal", "pubkey", pick(_KINDS, F.col("ordinal") % len(_KINDS)).alias("kind"), pick(DIRECTIONS, F.col("pubkey") % 3).alias("direction"))
    rules = F.create_map(*[F.lit(x) for k in _KINDS for i, d in enumerate(DIRECTIONS) for x in (f"{k}/{d}", RETENTION[k][i])])
    staked = F.broadcast(v_node.agg(F.count_if(F.col("stake") > 0).alias("staked")))
    joined = rows.join(v_node.select("pubkey", "stake"), "pubkey", "left").crossJoin(staked)
    rule = F.element_at(rules, F.concat_ws("/", "kind", "direction"))
    enough = (F.col("staked") < LEAST_STAKED) | (F.coalesce("stake", F.lit(0)) >= 1000)
    return joined.select("ordinal", "kind", "direction", F.when(rule == "Y", True).when(rule == "N", False).otherwise(enough).alias("retained"))


BITS = "unnest([CAST(concat('0x', substr(hash, 3, 3)) AS BIGINT), CAST(concat('0x', substr(hash, 7, 3)) AS BIGINT), CAST(concat('0x', substr(hash, 11, 3)) AS BIGINT)]) AS bit"


@query(f"WITH b AS (SELECT DISTINCT prefix, bit FROM (SELECT substr(hash, 1, 1) AS prefix, {BITS} FROM v_gossip)) SELECT prefix, count(*) AS set_bits, array_to_string(list(bit ORDER BY bit), ',') AS bits FROM b GROUP BY prefix")
def bloom_digest(v_gossip):
    """Membership digests: a 4096-bit filter with three hashes for each hash prefix, as its set bits."""
    return digests.filters(v_gossip, "hash").groupBy("prefix").agg(F.count("*").alias("set_bits"), F.array_join(F.transform(F.sort_array(F.collect_set("bit")), lambda x: x.cast("string")), ",").alias("bits"))


@query(f"""WITH w AS (SELECT * FROM v_gossip QUALIFY row_number() OVER (PARTITION BY label ORDER BY wallclock DESC, hash DESC) = 1), n AS (SELECT max(wallclock) AS now FROM v_gossip),
b AS (SELECT DISTINCT prefix, bit FROM (SELECT substr(hash, 1, 1) AS prefix, {BITS} FROM v_gossip WHERE ordinal % 16 = 0)), s AS (SELECT label, hash, substr(hash, 1, 1) AS prefix, {BITS} FROM w, n WHERE wallclock <= now - {2 * DAY} AND kind <> 'error' AND substr(hash, 1, 1) IN ('0', '1', '2', '3', '4', '5', '6', '7'))
SELECT s.label, s.hash FROM s LEFT JOIN b ON b.prefix = s.prefix AND b.bit = s.bit GROUP BY s.label, s.hash HAVING count(b.bit) < 3""")
def pull_responses(v_gossip):
    """Live values that the caller's digests (half of the prefixes were sampled) don't contain and that aren't newer than the caller."""
    mine = digests.filters(v_gossip.where("ordinal % 16 = 0"), "hash").where("prefix < '8'")
    now = F.broadcast(v_gossip.agg(F.max("wallclock").alias("now")))
    live = dedupe.newest_per_key(v_gossip, ("label",), F.struct("wallclock", "hash")).crossJoin(now).where((F.col("wallclock") <= F.col("now") - 2 * DAY) & (F.col("kind") != "error") & (F.substring("hash", 1, 1) < "8"))
    return digests.lacking(live.select("label", "hash"), mine, "hash").select("label", "hash")


@query("""WITH c AS (SELECT slot, source % 3 AS origin, idx % 3 AS place, min(arrival) AS arrival FROM v_shred WHERE slot > 10 AND slot < 10 + 432000 GROUP BY ALL),
d AS (SELECT slot, origin, max(arrival) AS complete FROM c GROUP BY ALL HAVING count(*) = 3), p AS (SELECT slot, arg_min(origin, complete) AS origin, min(complete) AS complete FROM d GROUP BY slot)
SELECT p.slot, p.origin, p.complete, (SELECT count(*) FROM v_shred s WHERE s.slot = p.slot AND s.arrival > p.complete) AS ignored FROM p""")
def proof_chunks(v_shred):
    """Duplicate-slot proofs from chunks (slot, origin, place of three): the first origin whose chunks are complete
    gives the slot's proof; what comes later for the slot is ignored, slots at or below the root are not taken."""
    chunks = v_shred.select("slot", (F.col("source") % 3).alias("origin"), (F.col("idx") % 3).alias("place"), F.lit(3).alias("places"), "arrival", F.col("sig").alias("body"))
    return proofs.assembled(chunks, root=10, slots=432_000).select("slot", "origin", "complete", "ignored")


@query("""WITH h AS (SELECT pubkey AS origin, count(DISTINCT label) AS entries, max(coalesce(stake, 0)) AS stake FROM v_gossip LEFT JOIN v_node USING (pubkey) GROUP BY pubkey), r AS (SELECT origin, least(entries, 3) AS kept, stake, coalesce(sum(least(entries, 3)) OVER (ORDER BY stake DESC, origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT origin, CAST(greatest(0, least(kept, 100 - before)) AS BIGINT) AS kept FROM r""")
def proof_buffer(v_gossip, v_node):
    """A buffer of 100 entries: at most three of an origin, those of the greatest stakes first."""
    entries = v_gossip.groupBy(F.col("pubkey").alias("origin")).agg(F.countDistinct("label").alias("entries"))
    held = entries.join(v_node.select(F.col("pubkey").alias("origin"), "stake"), "origin", "left").select("origin", F.least("entries", F.lit(3)).alias("held"), F.coalesce("stake", F.lit(0)).alias("stake"))
    return proofs.bounded(held, 100).select("origin", "kept")


@query("""SELECT pubkey, concat('1', CASE WHEN pubkey % 2 = 0 THEN '2' ELSE 'z' END) AS spelled, 2 AS size, CASE WHEN pubkey % 3 = 0 THEN '2 bytes instead of 32' WHEN pubkey % 3 = 1 THEN 'no base58 character: l' END AS error FROM v_peer""")
def base58_keys(v_peer):
    """Bytes spelled in base58, and what is wrong with keys that aren't 32 bytes or hold other characters."""
    raw = F.when(F.col("pubkey") % 2 == 0, F.unhex(F.lit("0001"))).otherwise(F.unhex(F.lit("0039")))
    key = F.when(F.col("pubkey") % 3 == 0, "12").when(F.col("pubkey") % 3 == 1, "12l").otherwise(F.lit("1" * 32))
    read = v_peer.select("pubkey", records.base58(raw).alias("spelled"), F.octet_length(raw).alias("size"), records.base58_bytes(key, 32).alias("read"))
    return read.select("pubkey", "spelled", "size", F.regexp_replace("read.error", "'", "").alias("error"))


@query("""SELECT c_custkey AS pubkey, length(c_name) AS size, CASE WHEN c_custkey % 3 = 0 THEN 'size' WHEN substr(c_name, 10, 3) = '000' AND c_custkey % 3 = 1 THEN 'memcmp' END AS met FROM customer WHERE (c_custkey % 3 = 0 AND octet_length(encode(c_name)) = 18) OR (c_custkey % 3 = 1 AND substr(c_name, 10, 3) = '000')""")
def program_filter(customer):
    """Account filters: an exact data size, or bytes given in base58 at an offset."""
    data = F.encode("c_name", "UTF-8")
    sized = (F.col("c_custkey") % 3 == 0) & (F.octet_length(data) == 18)
    compared = (F.col("c_custkey") % 3 == 1) & records.memcmp(data, 9, "HBnP")
    return customer.where(sized | compared).select(F.col("c_custkey").alias("pubkey"), F.length("c_name").alias("size"), F.when(sized, "size").otherwise("memcmp").alias("met"))


@query("""SELECT seq, ms, barrier, sum(CASE WHEN barrier THEN 1 ELSE 0 END) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS checkpoint FROM (SELECT seq, epoch_us(ts) // 1000 AS ms, seq % 500 = 499 AS barrier FROM v_event)""")
def checkpoint_barriers(v_event):
    """Barriers in the sequence: each event with the number of the checkpoint that its consumers had flushed."""
    marked = v_event.select("seq", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("seq") % 500 == 499).alias("barrier"), F.floor(F.col("seq") / 4096).alias("block"))
    one = F.when(F.col("barrier"), 1).otherwise(0)
    blocks = marked.groupBy("block").agg(F.sum(one).alias("n"))
    below = blocks.select("block", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    inner = F.sum(one).over(Window.partitionBy("block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("inner", inner).join(below, "block").select("seq", "ms", "barrier", (F.col("below") + F.col("inner")).alias("checkpoint"))
