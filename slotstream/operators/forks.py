"""Fork graph: depths, ancestors, tip, commitment and reorganisation.

Slots are dealt into blocks of neighbouring numbers.  One pass over each block follows every slot to
its head, the last ancestor within the block; the heads alone, usually a few a block, then find
their roots by pointer doubling (about log2 of the blocks on a chain in joins).  Where parents lie far
off every slot is a head of its own, and the doubling runs over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotstream.operators.shared import written

#: Slots of a block; a task holds the heads of one block.
BLOCK = 4096


def known(slots: DataFrame) -> DataFrame:
    """(slot, parent): a parent that is no slot itself counts as none."""
    present = slots.select(F.col("slot").alias("__p"))
    return slots.join(present, F.col("parent_slot") == F.col("__p"), "left").select("slot", F.col("__p").alias("parent"))


def _to_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, parent, block, head, hops, exit) of rows (slot, parent, block) in order: a parent further on in order ends the walk."""
    block, heads = None, {}
    for b in batches:
        head, hops, leaves = [], [], []
        for slot, parent, own in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
            if own != block:
                block, heads = own, {}
            found = heads.get(parent)
            heads[slot] = state = (found[0], found[1] + 1, found[2]) if found else (slot, 0, parent)
            head.append(state[0])
            hops.append(state[1])
            leaves.append(state[2])
        arrays = [b.column(0), b.column(1), b.column(2), *[pa.array(x, pa.int64()) for x in (head, hops, leaves)]]
        yield pa.RecordBatch.from_arrays(arrays, names=["slot", "parent", "block", "head", "hops", "exit"])


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slots on the way from flagged rows (slot, parent, block, head, flagged) to their heads, rows in falling order."""
    block, due = None, set()
    for b in batches:
        out = []
        for slot, parent, own, head, flagged in zip(*[b.column(k).to_pylist() for k in range(5)], strict=True):
            if own != block:
                block, due = own, set()
            if flagged or slot in due:
                due.discard(slot)
                out.append(slot)
                if head != slot:
                    due.add(parent)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["slot"])


class Index:
    """Depths of all slots, and what it takes to walk from a slot to its root.

    ``depth``: (slot, parent, depth, root).  ``jumps[k]``: (head, up), the head 2**k heads further up,
    null beyond the root.
    """

    def __init__(self, slots: DataFrame, width: int = BLOCK):
        rows = known(slots).select(F.col("slot").cast("bigint").alias("slot"), F.col("parent").cast("bigint").alias("parent"), F.floor(F.col("slot") / width).cast("bigint").alias("block"))
        dealt = rows.repartition("block").sortWithinPartitions("block", "slot")
        self.inner = written(dealt.mapInArrow(_to_heads, "slot bigint, parent bigint, block bigint, head bigint, hops bigint, exit bigint"), "to-heads")
        heads = self.inner.where("slot = head").select("head", "exit")
        above = self.inner.select(F.col("slot").alias("exit"), F.col("head").alias("up"), F.col("hops").alias("more"))
        now = heads.join(above, "exit", "left").select("head", "up", F.coalesce(F.col("more") + 1, F.lit(0)).alias("depth"), F.coalesce("up", "head").alias("root"))
        self.jumps: list[DataFrame] = []
        while True:
            now = written(now, "heads")
            if not now.where("up is not null").limit(1).count():
                break
            self.jumps.append(now.select("head", "up"))
            other = now.select(F.col("head").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("root").alias("top"))
            now = now.join(other, "up", "left").select("head", F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("top", "root").alias("root"))
        ends = now.select("head", F.col("depth").alias("below"), "root")
        self.depth = self.inner.join(ends, "head").select("slot", "parent", (F.col("hops") + F.col("below")).alias("depth"), "root")

    def chain(self, of: DataFrame) -> DataFrame:
        """All slots from the one slot in ``of`` (column ``slot``) to its root.

        From the longest jump down, each marked head also marks its ancestor there: every distance
        is one sum of powers of two, so no head is marked twice.  A marked head's exit is where the
        chain enters the next block; one falling pass over the blocks then walks from the entries.
        """
        first = of.join(self.inner, "slot").select("slot", "head")
        marked = first.select("head")
        for jump in reversed(self.jumps):
            both = F.filter(F.array("head", "up"), lambda x: x.isNotNull())
            marked = marked.join(jump, "head", "left").select(F.explode(both).alias("head"))
        exits = self.inner.where("slot = head").join(marked, "head", "left_semi").where("exit is not null").select(F.col("exit").alias("slot"))
        entries = written(first.select("slot").union(exits).withColumn("flagged", F.lit(True)), "entries")
        rows = self.inner.join(entries, "slot", "left").select("slot", "parent", "block", "head", F.coalesce("flagged", F.lit(False)).alias("flagged"))
        return rows.repartition("block").sortWithinPartitions("block", F.desc("slot")).mapInArrow(_walked, "slot bigint")


def tip(depth: DataFrame) -> DataFrame:
    """The slot of greatest (depth, slot)."""
    return depth.agg(F.max_by("slot", F.struct("depth", "slot")).alias("tip"), F.max("depth").alias("depth"))


def status(index: Index, confirmed_hops: int, finalized_hops: int) -> DataFrame:
    """(slot, depth, status) of each slot: by the watermarks on the tip's chain, Orphaned off it."""
    best = tip(index.depth)
    main = index.chain(best.select(F.col("tip").alias("slot"))).withColumn("canonical", F.lit(True))
    on = index.depth.join(main, "slot", "left").crossJoin(F.broadcast(best.select(F.col("depth").alias("top"))))
    by_depth = F.when(F.col("top") - F.col("depth") >= finalized_hops, "Finalized").when(F.col("top") - F.col("depth") >= confirmed_hops, "Confirmed").otherwise("Processed")
    return on.select("slot", "depth", F.when(F.col("canonical"), by_depth).otherwise("Orphaned").alias("status"))


def reorg(index: Index, old: DataFrame, new: DataFrame) -> DataFrame:
    """(slot, side): the old chain's slots that go (detached) and the new chain's that come (attached)."""
    a, b = written(index.chain(old), "old-chain"), written(index.chain(new), "new-chain")
    return a.join(b, "slot", "left_anti").withColumn("side", F.lit("detached")).union(b.join(a, "slot", "left_anti").withColumn("side", F.lit("attached")))
