"""Queries over nodes and peers: rankings, views, targets and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotstream.functions import commitment
from slotstream.operators import tables
from slotstream.plans.registry import query

RTT = "r AS (SELECT source AS pubkey, count(*) FILTER (kind = 'view') AS send_ok, count(*) FILTER (kind = 'click') AS ping_ok, count(*) AS hits, count(*) FILTER (kind = 'error') AS errors, CAST(floor(avg(CAST(floor(value) AS BIGINT)) FILTER (kind = 'click')) AS BIGINT) AS rtt FROM v_event GROUP BY source)"


@query(f"""WITH {RTT}, s AS (SELECT p.pubkey, stake, CASE WHEN rtt IS NULL THEN 1000 ELSE 2500 - least(rtt, 2500) END + least(coalesce(send_ok, 0), 4096) + least(coalesce(ping_ok, 0), 4096) + 2 * least(coalesce(hits, 0), 8192) - 8 * least(coalesce(errors, 0), 4096) AS score FROM v_peer p LEFT JOIN r USING (pubkey))
SELECT pubkey, stake, score, least(greatest(score, 1), 100000) AS weight FROM s ORDER BY score DESC, stake DESC, pubkey LIMIT 25""")
def peer_score_topk(v_peer, v_event):
    """The 25 best repair peers by score."""
    value = F.floor("value").cast("bigint")
    stats = v_event.groupBy(F.col("source").alias("pubkey")).agg(F.count_if(F.col("kind") == "view").alias("send_ok"), F.count_if(F.col("kind") == "click").alias("ping_ok"), F.count("*").alias("hits"), F.count_if(F.col("kind") == "error").alias("errors"), F.floor(F.avg(F.when(F.col("kind") == "click", value))).cast("bigint").alias("rtt"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    score = commitment.peer_score(F.col("rtt"), zero("send_ok"), zero("ping_ok"), zero("hits"), zero("errors"))
    ranked = v_peer.join(stats, "pubkey", "left").select("pubkey", "stake", score.alias("score"))
    return ranked.orderBy(F.desc("score"), F.desc("stake"), "pubkey").limit(25).select("pubkey", "stake", "score", F.least(F.greatest("score", F.lit(1)), F.lit(100000)).alias("weight"))


@query("SELECT gossip_addr, arg_max(pubkey, stake * 10000000 - pubkey) AS pubkey, max(stake) AS stake FROM v_node GROUP BY gossip_addr")
def gossip_addr_dedupe(v_node):
    """One node per address: the greatest stake, the first key on a tie."""
    return v_node.groupBy("gossip_addr").agg(F.max_by("pubkey", F.struct("stake", -F.col("pubkey"))).alias("pubkey"), F.max("stake").alias("stake"))


@query("""WITH l AS (SELECT o_custkey AS pubkey, min(o_orderkey) AS lowest FROM orders GROUP BY 1)
SELECT pubkey, stake, lowest FROM v_node LEFT JOIN l USING (pubkey) WHERE shred_version < 20 AND tpu IS NOT NULL AND (lowest IS NULL OR lowest <= 3000)""")
def repair_peers(v_node, v_leader):
    """Nodes that can serve slot 3000: right version, reachable, lowest slot unknown or low enough."""
    lowest = v_leader.groupBy(F.col("leader").alias("pubkey")).agg(F.min("slot").alias("lowest"))
    return v_node.where("shred_version < 20 and tpu is not null").join(lowest, "pubkey", "left").where("lowest is null or lowest <= 3000").select("pubkey", "stake", "lowest")


def _snapshots(v_node):
    old = v_node.where("pubkey % 7 <> 0").select("pubkey", "stake", "tpu")
    new = v_node.where("pubkey % 11 <> 0").select("pubkey", (F.col("stake") + F.when(F.col("pubkey") % 5 == 0, 1).otherwise(0)).alias("stake"), "tpu")
    return old, new


@query("""WITH a AS (SELECT pubkey, stake, tpu FROM v_node WHERE pubkey % 7 <> 0), b AS (SELECT pubkey, stake + CASE WHEN pubkey % 5 = 0 THEN 1 ELSE 0 END AS stake, tpu FROM v_node WHERE pubkey % 11 <> 0)
SELECT pubkey, 'added' AS change FROM b WHERE pubkey NOT IN (SELECT pubkey FROM a) UNION ALL SELECT pubkey, 'removed' FROM a WHERE pubkey NOT IN (SELECT pubkey FROM b)
UNION ALL SELECT b.pubkey, 'updated' FROM a JOIN b ON a.pubkey = b.pubkey WHERE (a.stake, a.tpu) IS DISTINCT FROM (b.stake, b.tpu)""")
def topology_diff(v_node):
    return tables.diff(*_snapshots(v_node), "pubkey")


@query("""WITH a AS (SELECT slot, leader FROM v_leader WHERE slot % 9 <> 0), b AS (SELECT slot, leader + CASE WHEN slot % 10 = 3 THEN 1 ELSE 0 END AS leader FROM v_leader WHERE slot % 8 <> 0)
SELECT coalesce(a.slot, b.slot) AS slot, CASE WHEN a.slot IS NULL THEN 'added' WHEN b.slot IS NULL THEN 'removed' ELSE 'updated' END AS change FROM a FULL JOIN b ON a.slot = b.slot WHERE a.leader IS DISTINCT FROM b.leader""")
def leader_diff(v_leader):
    old = v_leader.where("slot % 9 <> 0")
    new = v_leader.where("slot % 8 <> 0").select("slot", (F.col("leader") + F.when(F.col("slot") % 10 == 3, 1).otherwise(0)).alias("leader"))
    return tables.diff(old, new, "slot")


@query("""WITH n AS (SELECT pubkey, tpu FROM v_node WHERE tpu IS NOT NULL), l AS (SELECT slot, leader FROM v_leader),
a AS (SELECT 0 AS part, slot AS ord, leader AS pubkey, tpu FROM l JOIN n ON leader = pubkey WHERE slot >= 12000
UNION ALL SELECT 1, -slot, leader, tpu FROM l JOIN n ON leader = pubkey WHERE slot < 12000 UNION ALL SELECT 2, pubkey, pubkey, tpu FROM n),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY tpu ORDER BY part, ord) = 1)
SELECT pubkey, tpu, CAST(part AS BIGINT) AS part, ord FROM f ORDER BY part, ord LIMIT 40""")
def leader_targets(v_node, v_leader):
    """Forty targets: leaders from slot 12000 on, then earlier ones downwards, then the rest; each address once."""
    reachable = v_node.where("tpu is not null").select("pubkey", "tpu")
    led = v_leader.join(reachable, F.col("leader") == F.col("pubkey"))
    parts = [led.where("slot >= 12000").select("pubkey", "tpu", F.col("slot").alias("ord")), led.where("slot < 12000").select("pubkey", "tpu", (-F.col("slot")).alias("ord")), reachable.select("pubkey", "tpu", F.col("pubkey").alias("ord"))]
    return tables.first_occurrence(parts, "tpu", ["ord"]).orderBy("part", "ord").limit(40).select("pubkey", "tpu", "part", "ord")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY gossip_addr ORDER BY stake DESC, pubkey DESC) AS turn FROM v_node WHERE shred_version <> 3 AND tpu IS NOT NULL)
SELECT pubkey, gossip_addr, stake FROM r WHERE turn <= 2 ORDER BY stake DESC, pubkey DESC LIMIT 30""")
def relay_peer_topk(v_node):
    """Thirty relay peers, at most two of one address."""
    kept = tables.top_per_group(v_node.where("shred_version <> 3 and tpu is not null"), ["gossip_addr"], [F.desc("stake"), F.desc("pubkey")], 2)
    return kept.orderBy(F.desc("stake"), F.desc("pubkey")).limit(30).select("pubkey", "gossip_addr", "stake")


@query("""SELECT pubkey, true AS in_all, shred_version = 5 AND pubkey <> 7 AS in_gossip, shred_version = 5 AND pubkey <> 7 AND tpu IS NOT NULL AS in_rpc, pubkey <> 7 AND tpu IS NOT NULL AS in_tpu,
stake > 0 AND substr(md5(CAST(pubkey AS VARCHAR)), 1, 1) = '0' AS sampled_inactive FROM v_node""")
def peer_views(v_node):
    """Which peer views each node is in; inactive staked nodes are kept one time in sixteen."""
    own, version, reach = F.col("pubkey") != 7, F.col("shred_version") == 5, F.col("tpu").isNotNull()
    sampled = (F.col("stake") > 0) & (F.substring(F.md5(F.col("pubkey").cast("string")), 1, 1) == "0")
    return v_node.select("pubkey", F.lit(True).alias("in_all"), (version & own).alias("in_gossip"), (version & own & reach).alias("in_rpc"), (own & reach).alias("in_tpu"), sampled.alias("sampled_inactive"))


@query("SELECT pubkey, stake FROM v_node WHERE gossip_addr = 13 ORDER BY stake DESC, pubkey LIMIT 5")
def topn_discovery(v_node):
    """Five nodes at one address."""
    return v_node.where("gossip_addr = 13").orderBy(F.desc("stake"), "pubkey").limit(5).select("pubkey", "stake")


@query("""WITH h AS (SELECT source, count(*) AS hits FROM v_shred GROUP BY source), c AS (SELECT p.pubkey, p.stake, coalesce(hits, 0) AS hits FROM v_peer p LEFT JOIN h ON h.source = p.pubkey),
m AS (SELECT * FROM c WHERE stake > 9000), e AS (SELECT count(*) AS n FROM m)
SELECT pubkey, stake, hits, 'primary' AS origin FROM m UNION ALL SELECT pubkey, stake, hits, 'fallback' FROM c, e WHERE n = 0""")
def candidate_peers(v_peer, v_shred):
    """Well-staked peers with their hit counts; all peers if there is none."""
    hits = v_shred.groupBy(F.col("source").alias("pubkey")).agg(F.count("*").alias("hits"))
    every = v_peer.join(hits, "pubkey", "left").select("pubkey", "stake", F.coalesce("hits", F.lit(0)).alias("hits"))
    first = every.where("stake > 9000").withColumn("origin", F.lit("primary"))
    none = first.agg(F.count("*").alias("n"))
    return first.union(every.crossJoin(F.broadcast(none)).where("n = 0").select("pubkey", "stake", "hits", F.lit("fallback").alias("origin")))


@query("""WITH b AS (SELECT pubkey, CAST(row_number() OVER (ORDER BY stake DESC, pubkey) AS BIGINT) AS bias FROM v_peer WHERE shred_version = 7)
SELECT p.pubkey, b.bias, p.stake % 50 AS probe_ms FROM v_peer p LEFT JOIN b USING (pubkey) WHERE p.stake > 0 ORDER BY p.stake % 2 DESC, coalesce(b.bias, 9999), p.stake % 50, p.pubkey LIMIT 15""")
def entrypoint_rank(v_peer):
    """Fifteen entry points: reachable ones, then by bias rank, probe time and name."""
    bias = F.row_number().over(Window.partitionBy("shred_version").orderBy(F.desc("stake"), "pubkey")).cast("bigint")
    ranked = v_peer.where("shred_version = 7").select("pubkey", bias.alias("bias"))
    out = v_peer.where("stake > 0").join(ranked, "pubkey", "left")
    return out.orderBy(F.desc(F.col("stake") % 2), F.coalesce("bias", F.lit(9999)), F.col("stake") % 50, "pubkey").limit(15).select("pubkey", "bias", (F.col("stake") % 50).alias("probe_ms"))


@query("""WITH l AS (SELECT shred_version, pubkey, CASE WHEN pubkey % 3 = 0 THEN NULL ELSE stake % 100 END AS latency FROM v_peer),
r AS (SELECT *, row_number() OVER (PARTITION BY shred_version ORDER BY coalesce(latency, 9223372036854775807), pubkey) - 1 AS pos, count(*) OVER (PARTITION BY shred_version) AS n FROM l)
SELECT shred_version, pubkey, latency, (pos - 3 + 3 * n) % n AS rotated FROM r""")
def latency_rank_rotate(v_peer):
    """Targets of each version by latency (unknown last), rotated by three for the next attempt."""
    latency = F.when(F.col("pubkey") % 3 == 0, F.lit(None)).otherwise(F.col("stake") % 100)
    each = v_peer.select("shred_version", "pubkey", latency.alias("latency"))
    group = Window.partitionBy("shred_version")
    pos = F.row_number().over(group.orderBy(F.asc_nulls_last("latency"), "pubkey")) - 1
    return each.select("shred_version", "pubkey", "latency", F.pmod(pos - 3, F.count("*").over(group)).alias("rotated"))


@query("""WITH h AS (SELECT pubkey, stake, (CAST(concat('0x', substr(md5(concat('sample:', pubkey)), 1, 12)) AS BIGINT) + 1) / 281474976710657.0 AS u FROM v_node)
SELECT pubkey, stake, CASE WHEN stake > 0 THEN CAST(length(bin(stake)) - 1 AS BIGINT) ELSE -1 END AS bucket FROM h ORDER BY CASE WHEN stake > 0 THEN -ln(u) / stake ELSE 'infinity'::DOUBLE END, pubkey LIMIT 50""")
def weighted_sample(v_node):
    """Fifty nodes by weighted sampling without replacement, and their buckets of stake."""
    key = tables.weighted_key(F.col("stake").cast("double"), F.col("pubkey").cast("string"))
    bucket = F.when(F.col("stake") > 0, F.length(F.bin("stake")) - 1).otherwise(-1).cast("bigint")
    return v_node.withColumn("key", key).orderBy("key", "pubkey").limit(50).select("pubkey", "stake", bucket.alias("bucket"))


@query("SELECT slot % 32 AS lane, arg_max(leader, slot) AS leader, max(slot) AS slot FROM v_leader GROUP BY 1")
def latest_leader(v_leader):
    return v_leader.groupBy((F.col("slot") % 32).alias("lane")).agg(F.max_by("leader", "slot").alias("leader"), F.max("slot").alias("slot"))


@query("""WITH p AS (SELECT * FROM (VALUES ('home', 256, 2, 50), ('vps', 1024, 4, 20), ('dedicated', 4096, 8, 10)) AS t(profile, queue, workers, wait_ms)),
d AS (SELECT * FROM (VALUES ('latency_optimized', 1, 1), ('balanced', 8, 2), ('delivery_disciplined', 32, 4)) AS t(delivery, batch, attempts))
SELECT profile, delivery, CAST(queue * workers AS BIGINT) AS capacity, CAST(wait_ms * attempts AS BIGINT) AS budget_ms, CAST(queue * workers * 75 // 100 AS BIGINT) AS shed_at FROM p CROSS JOIN d""")
def budget_profiles(spark):
    """Capacity and time budgets of each host profile and delivery preset (literal tables)."""
    hosts = [("home", 256, 2, 50), ("vps", 1024, 4, 20), ("dedicated", 4096, 8, 10)]
    presets = [("latency_optimized", 1, 1), ("balanced", 8, 2), ("delivery_disciplined", 32, 4)]
    rows = [(h, d, q * w, ms * a, q * w * 75 // 100) for h, q, w, ms in hosts for d, _, a in presets]
    return spark.createDataFrame(rows, "profile string, delivery string, capacity bigint, budget_ms bigint, shed_at bigint")


@query("""SELECT * FROM (VALUES ('websocket', 'block_meta'), ('websocket', 'slot_status'), ('generic', 'recent_blockhash')) AS t(mode, hook)""")
def capability_gap(spark):
    """Hooks that subscribers ask for and the ingress mode doesn't support."""
    supported = spark.createDataFrame([("grpc", "transaction"), ("grpc", "slot_status"), ("grpc", "block_meta"), ("websocket", "transaction"), ("websocket", "log"), ("generic", "transaction"), ("generic", "log")], "mode string, hook string")
    wanted = spark.createDataFrame([("grpc", "transaction"), ("grpc", "block_meta"), ("websocket", "transaction"), ("websocket", "block_meta"), ("websocket", "slot_status"), ("generic", "log"), ("generic", "recent_blockhash")], "mode string, hook string")
    return wanted.join(F.broadcast(supported), ["mode", "hook"], "left_anti")


@query("""WITH ops AS (SELECT pubkey, 0 AS seq, 'snapshot' AS op, stake FROM v_node UNION ALL SELECT pubkey, 1, 'upsert', stake + 10 FROM v_node WHERE pubkey % 4 = 0 UNION ALL SELECT pubkey, 2, 'delete', 0 FROM v_node WHERE pubkey % 6 = 0 UNION ALL SELECT pubkey, 3, 'upsert', stake + 20 FROM v_node WHERE pubkey % 12 = 0)
SELECT pubkey, arg_max(stake, seq) AS stake FROM ops GROUP BY pubkey HAVING arg_max(op, seq) <> 'delete'""")
def topology_replay(v_node):
    """Topology after a snapshot, upserts, deletes and upserts again."""
    op = lambda frame, seq, name, stake: frame.select("pubkey", F.lit(seq).alias("seq"), F.lit(name).alias("op"), stake.cast("bigint").alias("stake"), F.lit(0).alias("snapshot_at"))
    steps = [op(v_node, 0, "snapshot", F.col("stake")), op(v_node.where("pubkey % 4 = 0"), 1, "upsert", F.col("stake") + 10), op(v_node.where("pubkey % 6 = 0"), 2, "delete", F.lit(0)), op(v_node.where("pubkey % 12 = 0"), 3, "upsert", F.col("stake") + 20)]
    ops = steps[0].union(steps[1]).union(steps[2]).union(steps[3])
    return tables.replayed(ops, "pubkey", "seq", "stake")


@query("""SELECT a.pubkey, a.gossip_addr, EXISTS (SELECT 1 FROM v_node b WHERE b.gossip_addr = a.gossip_addr AND (b.stake, b.pubkey) > (a.stake, a.pubkey)) AS overridden FROM v_node a""")
def contact_override(v_node):
    """Whether another contact of the same address is newer (greater stake, then key)."""
    best = v_node.groupBy("gossip_addr").agg(F.max(F.struct("stake", "pubkey")).alias("best"))
    return v_node.join(best, "gossip_addr").select("pubkey", "gossip_addr", (F.col("best") > F.struct("stake", "pubkey")).alias("overridden"))
