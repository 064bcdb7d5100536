"""Queries over the control plane and the ordered feed."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotstream.functions import commitment
from slotstream.plans.registry import query

LANES = 8
FILL = """f AS (SELECT seq, slot, slot % 8 AS lane, max(CASE WHEN input = 'recent_blockhash' THEN watermark_slot END) OVER w AS blockhash, max(CASE WHEN input = 'cluster_topology' THEN watermark_slot END) OVER w AS topology,
max(CASE WHEN input = 'leader_schedule' THEN watermark_slot END) OVER w AS schedule, max(slot) OVER w AS tip, max(slot) OVER w - slot % 3 AS confirmed, max(slot) OVER w - slot % 2 AS finalized FROM v_control WINDOW w AS (PARTITION BY slot % 8 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
FRESH = "CASE WHEN {0} IS NULL THEN 'Missing' WHEN greatest(tip - {0}, 0) > {1} THEN 'Stale' ELSE 'Fresh' END"
LAG = {"blockhash": 32, "topology": 64, "schedule": 128}
QUALITY = f"""q AS (SELECT *, {', '.join(FRESH.format(k, v) + f' AS {k}_state' for k, v in LAG.items())}, greatest(blockhash, topology, schedule) - least(blockhash, topology, schedule) AS spread FROM f),
g AS (SELECT *, CASE WHEN 'Missing' IN (blockhash_state, topology_state, schedule_state) THEN 'IncompleteControlPlane' WHEN 'Stale' IN (blockhash_state, topology_state, schedule_state) THEN 'Stale' WHEN spread > 32 THEN 'Degraded'
WHEN finalized <> tip THEN CASE WHEN confirmed = tip THEN 'Provisional' ELSE 'ReorgRisk' END ELSE 'Stable' END AS quality FROM q)"""


def _filled(v_control):
    """Latest observation of each input and the watermarks at every row, lane by lane."""
    w = Window.partitionBy("lane").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lambda name: F.max(F.when(F.col("input") == name, F.col("watermark_slot"))).over(w)
    tip = F.max("slot").over(w)
    return v_control.withColumn("lane", F.col("slot") % LANES).select("seq", "slot", "lane", seen("recent_blockhash").alias("blockhash"), seen("cluster_topology").alias("topology"), seen("leader_schedule").alias("schedule"), tip.alias("tip"), (tip - F.col("slot") % 3).alias("confirmed"), (tip - F.col("slot") % 2).alias("finalized"))


def _graded(v_control):
    f = _filled(v_control)
    states = {k: commitment.freshness(F.col(k), F.col("tip"), lag) for k, lag in LAG.items()}
    spread = commitment.spread(F.col("blockhash"), F.col("topology"), F.col("schedule"))
    grade = commitment.quality(list(states.values()), spread, 32, F.col("tip"), F.col("confirmed"), F.col("finalized"))
    return f.select("*", *[s.alias(f"{k}_state") for k, s in states.items()], spread.alias("spread"), grade.alias("quality"))


@query(f"""WITH {FILL}, {QUALITY} SELECT seq, slot, blockhash_state, topology_state, schedule_state, spread, quality,
quality <> 'Stable' AND coalesce(lag(quality) OVER (PARTITION BY lane ORDER BY seq), 'Stable') = 'Stable' AS invalidates FROM g""")
def control_plane_quality(v_control):
    """Freshness, spread and quality at every observation, and where safety is lost."""
    before = F.coalesce(F.lag("quality").over(Window.partitionBy("lane").orderBy("seq")), F.lit("Stable"))
    return _graded(v_control).select("seq", "slot", "blockhash_state", "topology_state", "schedule_state", "spread", "quality", ((F.col("quality") != "Stable") & (before == "Stable")).alias("invalidates"))


@query(f"""WITH {FILL}, {QUALITY}, i AS (SELECT seq, list_filter([CASE WHEN blockhash IS NULL THEN 'missing_blockhash' END, CASE WHEN topology IS NULL THEN 'missing_topology' END, CASE WHEN blockhash_state = 'Stale' THEN 'stale_blockhash' END, CASE WHEN schedule_state = 'Stale' THEN 'stale_schedule' END, CASE WHEN spread > 8 THEN 'spread' END, CASE WHEN finalized <> tip THEN 'reorg_risk' END], lambda x: x IS NOT NULL) AS issues FROM g)
SELECT seq, array_to_string(issues, ',') AS issues, CAST(len(issues) AS BIGINT) AS n_issues, CASE WHEN len(issues) = 0 THEN 'Stable' WHEN list_contains(issues, 'missing_blockhash') OR list_contains(issues, 'missing_topology') THEN 'Incomplete' WHEN list_contains(issues, 'stale_blockhash') OR list_contains(issues, 'stale_schedule') THEN 'Stale' ELSE 'Degraded' END AS level FROM i""")
def flow_safety_issues(v_control):
    """Every issue under a strict policy, and the four-level verdict."""
    g = _graded(v_control)
    rules = [("missing_blockhash", F.col("blockhash").isNull()), ("missing_topology", F.col("topology").isNull()), ("stale_blockhash", F.col("blockhash_state") == "Stale"), ("stale_schedule", F.col("schedule_state") == "Stale"), ("spread", F.col("spread") > 8), ("reorg_risk", F.col("finalized") != F.col("tip"))]
    issues = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    some = lambda *names: F.arrays_overlap("issues", F.array(*[F.lit(n) for n in names]))
    level = F.when(F.size("issues") == 0, "Stable").when(some("missing_blockhash", "missing_topology"), "Incomplete").when(some("stale_blockhash", "stale_schedule"), "Stale").otherwise("Degraded")
    return g.select("seq", issues.alias("issues")).select("seq", F.array_join("issues", ",").alias("text"), F.size("issues").cast("bigint").alias("n_issues"), level.alias("level")).withColumnRenamed("text", "issues")


@query("SELECT conv_id AS session, turn AS sequence, CASE WHEN lead(turn) OVER w IS NULL THEN 'head' WHEN lead(turn) OVER w = turn + 1 THEN 'ok' ELSE 'gap' END AS continuity, row_number() OVER w = 1 AND turn > 0 AS truncated FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def feed_sequence_check(conversations):
    """Continuity of each session's feed: gaps, head and truncation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    ahead = F.lead("turn").over(w)
    state = F.when(ahead.isNull(), "head").when(ahead == F.col("turn") + 1, "ok").otherwise("gap")
    return conversations.select(F.col("conv_id").alias("session"), F.col("turn").alias("sequence"), state.alias("continuity"), ((F.row_number().over(w) == 1) & (F.col("turn") > 0)).alias("truncated"))


@query("""WITH k AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations WHERE conv_id >= (SELECT max(conv_id) - 50 FROM conversations))
SELECT conv_id AS session, turn AS sequence FROM k WHERE age <= 3""")
def feed_retention(conversations):
    """The newest three envelopes of the newest fifty-one sessions."""
    floor = conversations.agg((F.max("conv_id") - 50).alias("floor"))
    kept = conversations.crossJoin(F.broadcast(floor)).where("conv_id >= floor")
    age = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return kept.withColumn("age", age).where("age <= 3").select(F.col("conv_id").alias("session"), F.col("turn").alias("sequence"))
