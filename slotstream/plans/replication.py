"""Queries over the replicated last-writer-wins table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotstream.operators import dedupe
from slotstream.plans.registry import query

LWW = "w AS (SELECT * FROM v_gossip QUALIFY row_number() OVER (PARTITION BY label ORDER BY wallclock DESC, hash DESC) = 1)"
NOW = "n AS (SELECT max(wallclock) AS now FROM v_gossip)"
DAY = 86_400_000


def _winners(v_gossip):
    return dedupe.newest_per_key(v_gossip, ("label",), F.struct("wallclock", "hash"))


def _now(v_gossip):
    return F.broadcast(v_gossip.agg(F.max("wallclock").alias("now")))


@query(f"WITH {LWW} SELECT label, pubkey, wallclock, hash, ordinal FROM w")
def crds_lww(v_gossip):
    """The live value of each label: greatest wallclock, then greatest hash."""
    return _winners(v_gossip).select("label", "pubkey", "wallclock", "hash", "ordinal")


@query(f"""WITH {LWW}, {NOW}, c AS (SELECT pubkey, max(wallclock) AS contact FROM w WHERE kind = 'view' GROUP BY pubkey)
SELECT label FROM w LEFT JOIN c USING (pubkey) LEFT JOIN v_node USING (pubkey), n
WHERE wallclock + CASE WHEN coalesce(stake, 0) > 0 THEN {5 * DAY} ELSE {2 * DAY} END <= now AND NOT coalesce(contact + {3 * DAY} > now, false)""")
def crds_expired(v_gossip, v_node):
    """Expired values: older than the owner's timeout, unless the owner's contact value is fresh."""
    live = _winners(v_gossip)
    contact = live.where("kind = 'view'").groupBy("pubkey").agg(F.max("wallclock").alias("contact"))
    timeout = F.when(F.coalesce("stake", F.lit(0)) > 0, 5 * DAY).otherwise(2 * DAY)
    joined = live.join(contact, "pubkey", "left").join(v_node.select("pubkey", "stake"), "pubkey", "left").crossJoin(_now(v_gossip))
    return joined.where((F.col("wallclock") + timeout <= F.col("now")) & ~F.coalesce(F.col("contact") + 3 * DAY > F.col("now"), F.lit(False))).select("label")


@query("""WITH c AS (SELECT count(*) AS n FROM v_node), r AS (SELECT pubkey, row_number() OVER (ORDER BY stake, pubkey) AS k FROM v_node WHERE pubkey <> 1)
SELECT pubkey, stake FROM v_node WHERE pubkey NOT IN (SELECT pubkey FROM r WHERE k <= 100) ORDER BY pubkey""")
def crds_trim(v_node):
    """The table without its hundred lowest stakes (never the own node): a bounded top-k, then an anti-join."""
    lowest = v_node.where("pubkey <> 1").orderBy("stake", "pubkey").limit(100).select("pubkey")
    return v_node.join(F.broadcast(lowest), "pubkey", "left_anti").select("pubkey", "stake")


@query("""WITH s AS (SELECT g.kind AS origin, g.pubkey, count(*) AS score, max(coalesce(stake, 0)) AS stake FROM v_gossip g LEFT JOIN v_node USING (pubkey) GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS pos, coalesce(sum(stake) OVER (PARTITION BY origin ORDER BY score DESC, stake DESC, pubkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(stake) OVER (PARTITION BY origin) AS total FROM s WINDOW w AS (PARTITION BY origin ORDER BY score DESC, stake DESC, pubkey))
SELECT origin, pubkey FROM r WHERE pos > 2 AND before * 100 >= total * 15""")
def crds_prune(v_gossip, v_node):
    """Relays to prune per origin: beyond two, once those ahead hold 15 percent of the stake.

    Relays of one origin and score are a level; ranks and stakes ahead are summed over the levels
    (few: one for each score) and then within a level, so that an origin isn't one sorted group.
    """
    scored = v_gossip.groupBy(F.col("kind").alias("origin"), "pubkey").agg(F.count("*").alias("score")).join(v_node.select("pubkey", "stake"), "pubkey", "left").na.fill(0, ["stake"])
    levels = scored.groupBy("origin", "score").agg(F.count("*").alias("n"), F.sum("stake").alias("held"))
    above = Window.partitionBy("origin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    levels = levels.select("origin", "score", sums("n", above).alias("ranks"), sums("held", above).alias("ahead"), F.sum("held").over(Window.partitionBy("origin")).alias("total"))
    order = Window.partitionBy("origin", "score").orderBy(F.desc("stake"), "pubkey")
    ranked = scored.withColumns({"pos": F.row_number().over(order), "own": sums("stake", order.rowsBetween(Window.unboundedPreceding, -1))}).join(levels, ["origin", "score"])
    return ranked.where((F.col("ranks") + F.col("pos") > 2) & ((F.col("ahead") + F.col("own")) * 100 >= F.col("total") * 15)).select("origin", "pubkey")


@query("SELECT ordinal, label FROM v_gossip WHERE substr(hash, 1, 2) IN ('0a', '0b') AND kind <> 'signup'")
def hash_prefix_filter(v_gossip):
    """Values whose hash begins with seven mask bits, but for one retired kind."""
    prefix = F.conv(F.substring("hash", 1, 2), 16, 10).cast("int")
    return v_gossip.where((F.shiftright(prefix, 1) == (0x0A >> 1)) & (F.col("kind") != "signup")).select("ordinal", "label")


@query(f"WITH {LWW}, {NOW} SELECT label, hash FROM w, n WHERE wallclock >= now - {20 * DAY} AND hash NOT IN (SELECT hash FROM v_gossip WHERE ordinal % 3 = 0)")
def pull_missing(v_gossip):
    """Live values within the window that the caller (who has every third value) lacks."""
    has = v_gossip.where("ordinal % 3 = 0").select("hash")
    recent = _winners(v_gossip).crossJoin(_now(v_gossip)).where(F.col("wallclock") >= F.col("now") - 20 * DAY)
    return recent.join(has, "hash", "left_anti").select("label", "hash")


@query(f"""WITH {NOW} SELECT ordinal, CASE WHEN kind = 'error' THEN 'rejected' WHEN wallclock < now - {15 * DAY} THEN 'outside_window' WHEN kind = 'signup' AND coalesce(stake, 0) = 0 THEN 'unstaked' ELSE 'retained' END AS verdict
FROM v_gossip LEFT JOIN v_node USING (pubkey), n""")
def gossip_retain(v_gossip, v_node):
    """Retention by kind, window and the owner's stake."""
    joined = v_gossip.join(v_node.select("pubkey", "stake"), "pubkey", "left").crossJoin(_now(v_gossip))
    verdict = F.when(F.col("kind") == "error", "rejected").when(F.col("wallclock") < F.col("now") - 15 * DAY, "outside_window").when((F.col("kind") == "signup") & (F.coalesce("stake", F.lit(0)) == 0), "unstaked").otherwise("retained")
    return joined.select("ordinal", verdict.alias("verdict"))


@query(f"""WITH {LWW}, {NOW}, o AS (SELECT DISTINCT pubkey FROM v_gossip WHERE ordinal % 2 = 0)
SELECT g.ordinal, CASE WHEN (g.wallclock, g.hash) < (w.wallclock, w.hash) THEN 'failed' WHEN g.wallclock + {4 * DAY} > now THEN 'active' WHEN o.pubkey IS NOT NULL THEN 'expired' ELSE 'failed' END AS fate
FROM v_gossip g JOIN w ON w.label = g.label LEFT JOIN o ON o.pubkey = g.pubkey, n""")
def pull_response_split(v_gossip):
    """Incoming values: active, expired with a known owner, or failed."""
    best = v_gossip.groupBy("label").agg(F.max(F.struct("wallclock", "hash")).alias("best"))
    owner = v_gossip.where("ordinal % 2 = 0").select("pubkey").distinct().withColumn("known", F.lit(True))
    joined = v_gossip.join(best, "label").join(owner, "pubkey", "left").crossJoin(_now(v_gossip))
    fate = F.when(F.struct("wallclock", "hash") < F.col("best"), "failed").when(F.col("wallclock") + 4 * DAY > F.col("now"), "active").when(F.col("known"), "expired").otherwise("failed")
    return joined.select("ordinal", fate.alias("fate"))


@query("SELECT kind, pubkey AS origin, count(*) AS dups FROM v_gossip GROUP BY ALL HAVING count(*) >= 2")
def prune_map(v_gossip):
    """Per kind the origins seen twice or more: a row each, so that no kind is gathered."""
    return v_gossip.groupBy("kind", F.col("pubkey").alias("origin")).agg(F.count("*").alias("dups")).where("dups >= 2")


@query("""WITH c AS (SELECT kind, ordinal, label, row_number() OVER (PARTITION BY kind ORDER BY ordinal) AS turn FROM v_gossip WHERE ordinal >= 500) SELECT kind, ordinal, label FROM c WHERE turn <= 64""")
def cursor_incremental(v_gossip):
    """The next 64 values of each kind from an insert cursor on."""
    turn = F.row_number().over(Window.partitionBy("kind").orderBy("ordinal"))
    return v_gossip.where("ordinal >= 500").withColumn("turn", turn).where("turn <= 64").select("kind", "ordinal", "label")


@query("""WITH v AS (SELECT pubkey, ordinal, (row_number() OVER (PARTITION BY pubkey ORDER BY ordinal) - 1) % 12 AS vote_index FROM v_gossip WHERE kind = 'click')
SELECT pubkey, vote_index, max(ordinal) AS ordinal FROM v GROUP BY ALL""")
def vote_index_overwrite(v_gossip):
    """Votes in twelve slots per owner, each new one over the oldest."""
    turn = F.row_number().over(Window.partitionBy("pubkey").orderBy("ordinal"))
    votes = v_gossip.where("kind = 'click'").select("pubkey", "ordinal", ((turn - 1) % 12).cast("bigint").alias("vote_index"))
    return votes.groupBy("pubkey", "vote_index").agg(F.max("ordinal").alias("ordinal"))
