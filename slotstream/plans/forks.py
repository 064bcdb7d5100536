"""Queries over the fork graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from slotstream.functions import commitment
from slotstream.operators import forks
from slotstream.plans.registry import query

DEPTH = """k AS (SELECT s.slot, p.slot AS parent FROM v_slot s LEFT JOIN v_slot p ON p.slot = s.parent_slot),
dep(slot, parent, depth, root) AS (SELECT slot, parent, CAST(0 AS BIGINT), slot FROM k WHERE parent IS NULL UNION ALL SELECT k.slot, k.parent, depth + 1, root FROM k JOIN dep ON k.parent = dep.slot)"""
TIP = "tip AS (SELECT slot, depth FROM dep ORDER BY depth DESC, slot DESC LIMIT 1)"
MAIN = "main(slot) AS (SELECT slot FROM tip UNION ALL SELECT k.parent FROM k JOIN main ON k.slot = main.slot WHERE k.parent IS NOT NULL)"


@query("SELECT s.slot, s.parent_slot, p.slot IS NOT NULL AS parent_seen FROM v_slot s LEFT JOIN v_slot p ON p.slot = s.parent_slot")
def parent_slot(v_slot):
    """Each slot's parent and whether it has been seen."""
    seen = v_slot.select(F.col("slot").alias("p"))
    return v_slot.join(seen, F.col("parent_slot") == F.col("p"), "left").select("slot", "parent_slot", F.col("p").isNotNull().alias("parent_seen"))


@query(f"WITH {DEPTH} SELECT * FROM dep", recursive=True)
def fork_depth(v_slot):
    return forks.Index(v_slot).depth


@query(f"WITH {DEPTH}, {TIP} SELECT slot AS tip, depth FROM tip", recursive=True)
def fork_tip(v_slot):
    return forks.tip(forks.Index(v_slot).depth)


@query(f"""WITH {DEPTH}, {TIP}, {MAIN}
SELECT slot, dep.depth, CASE WHEN slot NOT IN (SELECT slot FROM main) THEN 'Orphaned' WHEN (SELECT depth FROM tip) - dep.depth >= 150 THEN 'Finalized' WHEN (SELECT depth FROM tip) - dep.depth >= 32 THEN 'Confirmed' ELSE 'Processed' END AS status FROM dep""", recursive=True)
def fork_status(v_slot):
    return forks.status(forks.Index(v_slot), commitment.CONFIRMED_DEPTH, commitment.FINALIZED_DEPTH)


@query(f"""WITH {DEPTH}, {TIP}, o AS (SELECT max(slot) AS slot FROM dep WHERE slot < (SELECT slot FROM tip) AND slot % 3 = 1),
a(slot) AS (SELECT slot FROM o UNION ALL SELECT k.parent FROM k JOIN a ON k.slot = a.slot WHERE k.parent IS NOT NULL), {MAIN}
SELECT slot, 'detached' AS side FROM a WHERE slot NOT IN (SELECT slot FROM main) UNION ALL SELECT slot, 'attached' FROM main WHERE slot NOT IN (SELECT slot FROM a)""", recursive=True)
def reorg_diff(v_slot):
    """Slots that leave and join when the tip moves from the newest slot of residue 1 to the best one."""
    index = forks.Index(v_slot)
    new = forks.tip(index.depth).select(F.col("tip").alias("slot"))
    old = index.depth.crossJoin(F.broadcast(new.withColumnRenamed("slot", "t"))).where("slot < t and slot % 3 = 1").agg(F.max("slot").alias("slot"))
    return forks.reorg(index, old, new)


@query("""WITH e AS (SELECT slot, CAST(floor(slot / 432) AS BIGINT) AS epoch FROM v_slot), f AS (SELECT epoch, min(slot) AS first_slot, count(*) AS slots FROM e GROUP BY epoch)
SELECT epoch, first_slot, slots, first_slot = epoch * 432 AS at_boundary FROM f""")
def epoch_boundary(v_slot):
    """The first seen slot of each epoch, and whether it is the epoch's first slot."""
    epoch = F.floor(F.col("slot") / 432).cast("bigint")
    return v_slot.groupBy(epoch.alias("epoch")).agg(F.min("slot").alias("first_slot"), F.count("*").alias("slots")).select("epoch", "first_slot", "slots", (F.col("first_slot") == F.col("epoch") * 432).alias("at_boundary"))


@query("""SELECT s.slot, s.slot + i AS expanded FROM v_slot s, unnest(range(0, s.slot % 3 + 1)) AS t(i) WHERE s.slot + i >= 1000""")
def slot_expand(v_slot):
    """Run-length encoded slots back to single ones, from slot 1000 on."""
    return v_slot.select("slot", F.explode(F.sequence("slot", F.col("slot") + F.col("slot") % 3)).alias("expanded")).where("expanded >= 1000")


@query("SELECT s.slot, l.leader, lag(l.leader) OVER (PARTITION BY s.slot % 16 ORDER BY s.slot) IS DISTINCT FROM l.leader AS changed FROM v_slot s JOIN v_leader l USING (slot)")
def leader_changes(v_slot, v_leader):
    """Whether the leader differs from the one before on the same of sixteen lanes."""
    before = F.lag("leader").over(Window.partitionBy(F.col("slot") % 16).orderBy("slot"))
    return v_slot.join(v_leader, "slot").select("slot", "leader", (~before.eqNullSafe(F.col("leader"))).alias("changed"))
