"""Queries over fragments: deduplication, reassembly, gaps, coverage and repair."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotstream.functions import commitment
from slotstream.operators import dedupe, islands
from slotstream.plans.registry import query

ACC = "acc AS (SELECT * FROM v_shred QUALIFY row_number() OVER (PARTITION BY slot, idx ORDER BY arrival) = 1)"
OBS = """obs AS (SELECT *, CASE WHEN sig <> first_value(sig) OVER (PARTITION BY slot, idx ORDER BY arrival) THEN 'Conflict'
  WHEN row_number() OVER (PARTITION BY slot, idx, sig ORDER BY arrival) > 1 THEN 'Duplicate' ELSE 'Accepted' END AS observation FROM v_shred)"""
ISL = "isl AS (SELECT *, idx - row_number() OVER (PARTITION BY slot ORDER BY idx) AS island FROM acc)"
PART = "part AS (SELECT *, coalesce(sum(CASE WHEN data_complete THEN 1 ELSE 0 END) OVER (PARTITION BY slot, island ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM isl)"
DS = """ds AS (SELECT slot, min(idx) AS start_index, max(idx) AS end_index, count(*) AS n_shreds, CAST(sum(payload_len) AS BIGINT) AS payload_len, bool_or(last_in_slot) AS last_in_slot
  FROM part GROUP BY slot, island, part HAVING bool_or(data_complete) AND (part > 0 OR min(idx) = 0 OR count(*) >= 2))"""


@query(f"""WITH {ACC}, {ISL}, {PART}, {DS}, {OBS},
c AS (SELECT slot, count(*) AS shreds, count(*) FILTER (observation = 'Duplicate') AS duplicates, count(*) FILTER (observation = 'Conflict') AS conflicts FROM obs GROUP BY slot),
p AS (SELECT slot, count(*) FILTER (island = -1) AS contiguous_prefix, max(idx) + 1 - count(*) AS missing FROM isl GROUP BY slot),
d AS (SELECT slot, count(*) AS datasets FROM ds GROUP BY slot)
SELECT c.*, coalesce(d.datasets, 0) AS datasets, contiguous_prefix, missing,
  CASE WHEN slot <= (SELECT max(slot) - 150 FROM v_shred) THEN 'Finalized' WHEN slot <= (SELECT max(slot) - 32 FROM v_shred) THEN 'Confirmed' ELSE 'Processed' END AS commitment
FROM c JOIN p USING (slot) LEFT JOIN d USING (slot)""")
def slot_coverage(v_shred):
    """Fragments, duplicates, conflicts, datasets, prefix, gaps and commitment of each slot."""
    tip = v_shred.agg(F.max("slot").alias("tip"))
    out = islands.coverage(dedupe.observed(v_shred)).crossJoin(F.broadcast(tip))
    status = commitment.from_slot(F.col("slot"), F.col("tip") - commitment.CONFIRMED_DEPTH, F.col("tip") - commitment.FINALIZED_DEPTH)
    return out.select("slot", "shreds", "duplicates", "conflicts", "datasets", F.col("prefix").alias("contiguous_prefix"), "missing", status.alias("commitment"))


@query(f"WITH {OBS} SELECT slot, idx, arrival, sig, observation FROM obs")
def shred_dedupe_observation(v_shred):
    return dedupe.observed(v_shred).select("slot", "idx", "arrival", "sig", "observation")


@query(f"WITH {OBS} SELECT slot % 100 AS bucket, observation, count(*) AS n FROM obs GROUP BY ALL")
def shred_dedupe_summary(v_shred):
    return dedupe.observed(v_shred).groupBy((F.col("slot") % 100).alias("bucket"), "observation").agg(F.count("*").alias("n"))


@query(f"WITH {ACC}, {ISL}, {PART}, {DS} SELECT * FROM ds")
def dataset_islands(v_shred):
    return islands.datasets(dedupe.accepted(v_shred))


@query(f"""WITH {ACC} SELECT slot, max(idx) FILTER (last_in_slot) AS last_index, CAST(sum(payload_len) AS BIGINT) AS payload_len,
coalesce(count(*) = max(idx) FILTER (last_in_slot) + 1 AND max(idx) = max(idx) FILTER (last_in_slot) AND arg_max(data_complete, idx), false) AS complete FROM acc GROUP BY slot""")
def slot_complete(v_shred):
    return islands.whole_slots(dedupe.accepted(v_shred))


@query(f"""WITH {ACC}, {ISL}, a AS (SELECT slot, idx, coalesce(lag(data_complete) OVER (PARTITION BY slot, island ORDER BY idx), false) AS b, max(idx) OVER (PARTITION BY slot, island) AS end_index FROM isl)
SELECT slot, idx AS anchor_index, end_index, end_index - idx + 1 AS run FROM a WHERE idx = 0 OR b""")
def inline_open_prefix(v_shred):
    return islands.open_prefixes(dedupe.accepted(v_shred))


@query(f"""WITH {ACC}, m AS (SELECT slot, max(idx) AS top FROM acc GROUP BY slot)
SELECT slot, i AS missing FROM m, unnest(range(0, top)) AS t(i) WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.slot = m.slot AND acc.idx = i)""")
def missing_index(v_shred):
    return islands.gaps(dedupe.accepted(v_shred))


@query(f"""WITH {ACC}, g AS (SELECT slot, idx, count(*) OVER (PARTITION BY slot ORDER BY idx) AS k FROM acc)
SELECT slot, count(*) FILTER (idx = k - 1) AS prefix, min(idx) AS first_index, max(idx) AS last_index FROM g GROUP BY slot""")
def contiguous_prefix(v_shred):
    return islands.contiguous_prefix(dedupe.accepted(v_shred))


@query(f"""WITH {ACC} SELECT slot, fec_set, count(*) AS present, arg_min(sig, arrival) AS config,
CASE WHEN count(*) >= 4 THEN 'complete' WHEN count(*) >= 3 THEN 'recoverable' ELSE 'short' END AS state FROM acc GROUP BY slot, fec_set""")
def fec_set_status(v_shred):
    return islands.erasure_sets(dedupe.accepted(v_shred))


@query("""WITH l AS (SELECT * FROM v_shred QUALIFY row_number() OVER (PARTITION BY slot, idx ORDER BY arrival DESC) = 1),
r AS (SELECT slot, idx, payload_len, row_number() OVER (PARTITION BY slot ORDER BY idx) AS turn, CAST(sum(payload_len) OVER (PARTITION BY slot ORDER BY idx) AS BIGINT) AS spent FROM l WHERE idx BETWEEN 1 AND 5)
SELECT * FROM r WHERE turn <= 3 AND spent <= 80""")
def latest_payload_range(v_shred):
    """Newest payload of indexes 1..5 of each slot, ascending, within 3 rows and 80 bytes."""
    newest = dedupe.newest_per_key(v_shred.where("idx between 1 and 5").select("slot", "idx", "payload_len", "arrival"), ("slot", "idx"), F.col("arrival"))
    return islands.within_budget(newest, "payload_len", 80, 3).select("slot", "idx", "payload_len", F.col("turn").cast("bigint").alias("turn"), "spent")


@query("SELECT slot, max(idx) AS idx, arg_max(payload_len, idx * 1000 + arrival) AS payload_len FROM v_shred WHERE idx > 2 GROUP BY slot")
def highest_above(v_shred):
    """The newest payload of the highest index above 2 of each slot."""
    return v_shred.where("idx > 2").groupBy("slot").agg(F.max("idx").alias("idx"), F.max_by("payload_len", F.struct("idx", "arrival")).alias("payload_len"))


@query(f"WITH {ACC} SELECT slot, idx, payload_len, CAST(sum(payload_len) OVER (PARTITION BY slot ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS suffix_len FROM acc")
def payload_suffix_len(v_shred):
    return dedupe.accepted(v_shred).select("slot", "idx", "payload_len", islands.suffix_sum("payload_len").alias("suffix_len"))


@query("""WITH s AS (SELECT source, max(slot) AS latest_slot, count(*) FILTER (sig <> 'R') AS data, count(*) FILTER (sig = 'R') AS code, count(*) FILTER (data_complete) AS complete, count(*) FILTER (last_in_slot) AS last FROM v_shred GROUP BY source)
SELECT source, latest_slot, 2 * data + code + 8 * complete + 16 * last AS score FROM s ORDER BY score DESC, latest_slot DESC, source LIMIT 20""")
def source_rank_topk(v_shred):
    """The twenty best sources by composite score."""
    code = F.col("sig") == "R"
    per = v_shred.groupBy("source").agg(F.max("slot").alias("latest_slot"), F.count_if(~code).alias("data"), F.count_if(code).alias("code"), F.count_if("data_complete").alias("complete"), F.count_if("last_in_slot").alias("last"))
    score = commitment.source_score(F.col("data"), F.col("code"), F.col("complete"), F.col("last"))
    return per.select("source", "latest_slot", score.alias("score")).orderBy(F.desc("score"), F.desc("latest_slot"), "source").limit(20)


@query(f"""WITH {ACC}, s AS (SELECT slot, bool_or(last_in_slot AND data_complete) AS has_last, max(idx) AS upper, max(idx) + 1 - count(*) AS gap, max(idx) - min(idx) AS span FROM acc GROUP BY slot),
m AS (SELECT s.*, i AS missing FROM s, unnest(range(0, upper)) AS t(i) WHERE NOT EXISTS (SELECT 1 FROM acc WHERE acc.slot = s.slot AND acc.idx = i)),
r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY missing) AS turn FROM m)
SELECT slot, missing, turn FROM r WHERE turn <= 2 ORDER BY upper DESC, slot DESC, has_last DESC, gap, span, missing LIMIT 200""")
def repair_request_plan(v_shred):
    """Gaps to ask for: at most two a slot, the first 200 by slot priority."""
    kept = dedupe.accepted(v_shred)
    state = kept.groupBy("slot").agg(F.bool_or(F.col("last_in_slot") & F.col("data_complete")).alias("has_last"), F.max("idx").alias("upper"), (F.max("idx") + 1 - F.count("*")).alias("gap"), (F.max("idx") - F.min("idx")).alias("span"))
    turn = F.row_number().over(Window.partitionBy("slot").orderBy("missing")).cast("bigint")
    asked = islands.gaps(kept).withColumn("turn", turn).where("turn <= 2").join(state, "slot")
    return asked.orderBy(F.desc("upper"), F.desc("slot"), F.desc("has_last"), "gap", "span", "missing").limit(200).select("slot", "missing", "turn")


@query("""WITH q AS (SELECT slot, idx, 'exact' AS kind FROM v_shred WHERE arrival = 1 UNION ALL SELECT slot, max(idx) - 1, 'highest' FROM v_shred GROUP BY slot UNION ALL SELECT slot, 99, 'exact' FROM v_slot WHERE slot % 7 = 0)
SELECT slot, idx, kind FROM q WHERE NOT EXISTS (SELECT 1 FROM v_shred a WHERE a.slot = q.slot AND a.arrival > 1 AND (CASE q.kind WHEN 'exact' THEN a.idx = q.idx ELSE a.idx >= q.idx END))""")
def outstanding_repairs(v_shred, v_slot):
    """Requests (exact index, or any index from one on) that no later arrival has answered."""
    exact = v_shred.where("arrival = 1").select("slot", "idx", F.lit("exact").alias("kind"))
    highest = v_shred.groupBy("slot").agg((F.max("idx") - 1).alias("idx")).withColumn("kind", F.lit("highest"))
    never = v_slot.where("slot % 7 = 0").select("slot", F.lit(99).cast("bigint").alias("idx"), F.lit("exact").alias("kind"))
    later = v_shred.where("arrival > 1")
    # The range match needs only each slot's greatest arrival, so both joins are equi-joins.
    top = later.groupBy("slot").agg(F.max("idx").alias("top"))
    asked = exact.union(highest).union(never)
    open_exact = asked.where("kind = 'exact'").join(later.select("slot", "idx").distinct(), ["slot", "idx"], "left_anti")
    open_range = asked.where("kind = 'highest'").join(top, "slot", "left").where(F.col("top").isNull() | (F.col("top") < F.col("idx"))).drop("top")
    return open_exact.unionByName(open_range)


@query("""WITH p AS (SELECT slot, idx, count(DISTINCT sig) AS payloads, count(DISTINCT fec_set) AS configs FROM v_shred GROUP BY slot, idx),
l AS (SELECT slot, count(DISTINCT idx) FILTER (last_in_slot) AS lasts FROM v_shred GROUP BY slot)
SELECT slot, idx, CASE WHEN lasts > 1 THEN 'last_index' WHEN payloads > 1 THEN 'payload' ELSE 'erasure_config' END AS reason FROM p JOIN l USING (slot) WHERE payloads > 1 OR lasts > 1 OR configs > 1""")
def duplicate_slot_proof(v_shred):
    """Indexes whose fragments prove two versions of a slot, and why."""
    index = v_shred.groupBy("slot", "idx").agg(F.countDistinct("sig").alias("payloads"), F.countDistinct("fec_set").alias("configs"))
    slot = v_shred.where("last_in_slot").groupBy("slot").agg(F.countDistinct("idx").alias("lasts"))
    reason = F.when(F.col("lasts") > 1, "last_index").when(F.col("payloads") > 1, "payload").otherwise("erasure_config")
    return index.join(slot, "slot", "left").where("payloads > 1 or lasts > 1 or configs > 1").select("slot", "idx", reason.alias("reason"))


@query("""SELECT slot, count(*) FILTER (sig <> 'R') AS data, count(*) FILTER (sig = 'R') AS code, count(*) FILTER (data_complete) AS datasets, CAST(sum(payload_len) AS BIGINT) AS bytes
FROM v_shred WHERE slot >= (SELECT max(slot) - 256 FROM v_shred) GROUP BY slot""")
def coverage_window(v_shred):
    """Counters of the newest 256 slots."""
    code = F.col("sig") == "R"
    return dedupe.since(v_shred, "slot", 256).groupBy("slot").agg(F.count_if(~code).alias("data"), F.count_if(code).alias("code"), F.count_if("data_complete").alias("datasets"), F.sum("payload_len").alias("bytes"))


@query("""WITH s AS (SELECT slot, max(fec_set) AS top FROM v_shred GROUP BY slot)
SELECT slot, i * 4 AS fec_set FROM s, unnest(range(0, CAST(top / 4 AS BIGINT) + 2)) AS t(i) WHERE NOT EXISTS (SELECT 1 FROM v_shred x WHERE x.slot = s.slot AND x.fec_set = i * 4)""")
def expected_sets_missing(v_shred):
    """Erasure sets up to one beyond the frontier of each slot that have no fragment."""
    frontier = v_shred.groupBy("slot").agg(F.max("fec_set").alias("top"), F.collect_set("fec_set").alias("have"))
    want = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.col("top") + 4, F.lit(4).cast("bigint")), F.col("have"))
    return frontier.select("slot", F.explode(want).alias("fec_set"))


@query(f"WITH {OBS} SELECT slot, idx, arrival, observation FROM obs WHERE slot >= (SELECT max(slot) - 1000 FROM v_shred)")
def dedupe_bounded(v_shred):
    """Deduplication that remembers the newest 1000 slots only."""
    return dedupe.observed(dedupe.since(v_shred, "slot", 1000)).select("slot", "idx", "arrival", "observation")


@query(f"WITH {ACC}, {ISL}, {PART}, {DS} SELECT slot, idx FROM acc WHERE NOT EXISTS (SELECT 1 FROM ds WHERE ds.slot = acc.slot AND acc.idx BETWEEN start_index AND end_index)")
def retired_ranges(v_shred):
    """Fragments left after the emitted datasets are retired."""
    kept = dedupe.accepted(v_shred)
    emitted = islands.datasets(kept).select("slot", F.explode(F.sequence("start_index", "end_index")).alias("idx"))
    return kept.select("slot", "idx").join(emitted, ["slot", "idx"], "left_anti")


@query("""WITH o AS (SELECT slot, idx, arrival, source, max(slot) OVER (PARTITION BY source ORDER BY (slot % 10) * 100000000 + slot * 10 + arrival ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM v_shred)
SELECT slot, idx, arrival, slot < top - 64 AS late FROM o""")
def late_drop(v_shred):
    """Fragments of each source that fall below its running newest slot less 64 (arrivals interleave ten slot strides)."""
    order = (F.col("slot") % 10) * 100000000 + F.col("slot") * 10 + F.col("arrival")
    return dedupe.late(v_shred.withColumn("turn", order), "slot", "turn", 64, ("source",)).select("slot", "idx", "arrival", "late")


@query("""WITH h AS (SELECT substr(md5(concat(CAST(slot AS VARCHAR), ':', CAST(fec_set AS VARCHAR))), 1, 1) AS worker, count(*) AS load FROM v_shred GROUP BY 1)
SELECT worker, load, row_number() OVER (ORDER BY load, worker) = 1 AS least_loaded FROM h""")
def hash_partition_load(v_shred):
    """Load of sixteen hash-dealt workers, and the least loaded one."""
    load = v_shred.groupBy(F.substring(F.md5(F.concat_ws(":", F.col("slot").cast("string"), F.col("fec_set").cast("string"))), 1, 1).alias("worker")).agg(F.count("*").alias("load"))
    best = load.agg(F.min_by("worker", F.struct("load", "worker")).alias("best"))
    return load.crossJoin(F.broadcast(best)).select("worker", "load", (F.col("worker") == F.col("best")).alias("least_loaded"))


@query("SELECT count(*) AS shreds, count(DISTINCT slot) AS slots, count(DISTINCT source) AS sources, CAST(sum(payload_len) AS BIGINT) AS bytes, max(payload_len) AS largest, count(*) FILTER (data_complete) AS boundaries FROM v_shred")
def metrics_rollup(v_shred):
    return v_shred.agg(F.count("*").alias("shreds"), F.countDistinct("slot").alias("slots"), F.countDistinct("source").alias("sources"), F.sum("payload_len").alias("bytes"), F.max("payload_len").alias("largest"), F.count_if("data_complete").alias("boundaries"))


@query("SELECT slot, count(DISTINCT source) AS targets, least(count(DISTINCT source), 2) AS required FROM v_shred GROUP BY slot")
def distinct_targets(v_shred):
    """Distinct targets of each slot, and the quorum they allow (two at most)."""
    n = F.countDistinct("source")
    return v_shred.groupBy("slot").agg(n.alias("targets"), F.least(n, F.lit(2)).cast("bigint").alias("required"))


@query("""WITH l AS (SELECT * FROM v_leader WHERE slot >= (SELECT max(slot) - 4096 FROM v_leader) AND slot % 11 <> 0),
s AS (SELECT v.slot, v.idx, v.arrival, CASE WHEN l.leader IS NULL THEN 'UnknownLeader' WHEN v.payload_len > 48 THEN 'Malformed' WHEN v.sig = 'R' AND v.source % 5 = 0 THEN 'InvalidSignature' ELSE 'Verified' END AS status FROM v_shred v LEFT JOIN l USING (slot))
SELECT *, status = 'Verified' AS accepted_strict, status IN ('Verified', 'UnknownLeader') AS accepted FROM s""")
def verify_accept(v_shred, v_leader):
    """Verification verdicts with the leaders of the newest 4096 slots, strict and lenient."""
    known = dedupe.since(v_leader, "slot", 4096).where("slot % 11 <> 0")
    joined = v_shred.join(known, "slot", "left")
    status = F.when(F.col("leader").isNull(), "UnknownLeader").when(F.col("payload_len") > 48, "Malformed").when((F.col("sig") == "R") & (F.col("source") % 5 == 0), "InvalidSignature").otherwise("Verified")
    out = joined.select("slot", "idx", "arrival", status.alias("status"))
    return out.select("*", (F.col("status") == "Verified").alias("accepted_strict"), F.col("status").isin("Verified", "UnknownLeader").alias("accepted"))
