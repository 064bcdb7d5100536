"""Typed views that bind the operators' inputs to the bundled tables.

Slot = order, fragment index = line number - 1, source = supplier, fork parent = order minus a
small offset, leader = customer, peer = supplier, replicated value = event, feed session =
conversation.  Each function is one projection or join; nothing here forces an action.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shreds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of slots; ``arrival`` numbers them within the slot."""
    idx = (F.col("l_linenumber") - 1).cast("bigint")
    # Renamed first: all later windows and aggregates on (slot, ...) then reuse this one shuffle.
    line = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("slot"), idx.alias("idx"), F.col("l_returnflag").alias("sig"), F.col("l_suppkey").alias("source"), F.floor("l_quantity").cast("bigint").alias("payload_len"), (F.col("l_linestatus") == "F").alias("ends"), "l_shipdate", "l_partkey"
    )
    slot = Window.partitionBy("slot")
    last = F.col("idx") == F.max("idx").over(slot)
    arrival = F.row_number().over(slot.orderBy("idx", "l_shipdate", "l_partkey", "source")).cast("bigint")
    marked = line.withColumns({"last_in_slot": last, "arrival": arrival})
    return marked.select("slot", "idx", "sig", "arrival", "source", "payload_len", (F.col("idx") - F.col("idx") % 4).alias("fec_set"), (F.col("ends") | F.col("last_in_slot")).alias("data_complete"), "last_in_slot")


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots and their parents (null for a root)."""
    parent = F.col("o_orderkey") - (1 + F.col("o_custkey") % 3)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot"), F.when(parent >= 0, parent).alias("parent_slot"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (transaction, instruction): transaction = slot, instruction number ``ix``."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    head = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return line.join(head, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("slot"),
        F.col("l_linenumber").cast("bigint").alias("ix"),
        F.col("l_partkey").alias("account"),
        F.col("l_suppkey").alias("program_account"),
        F.when(F.col("l_returnflag") == "R", "vote").when(F.col("l_returnflag") == "N", "budget").otherwise("other").alias("program"),
        F.col("o_custkey").alias("payer"),
        (F.col("o_orderstatus") == "F").alias("failed"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts"), F.col("user_id").alias("source"), F.col("event_type").alias("kind"), "value", "props", F.floor(F.col("event_id") / 4).cast("bigint").alias("slot")
    )


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same logical updates from three sources of different priority."""
    turn = F.col("event_id") % 3
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), turn.alias("source"), F.when(turn == 0, 200).when(turn == 1, 300).otherwise(100).cast("bigint").alias("priority"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("logical_key")
    )


def replicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the replicated table: label, owner, kind, wallclock (ms), hash, insert ordinal."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("label"),
        F.col("user_id").alias("pubkey"),
        F.col("event_type").alias("kind"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("wallclock"),
        F.md5(F.concat(F.col("event_id").cast("string"), F.col("props"))).alias("hash"),
        F.col("event_id").alias("ordinal"),
    )


def _stake(balance: str):
    return F.when(F.col(balance) > 0, F.floor(balance)).otherwise(0).cast("bigint")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.alias("pubkey"), F.col("c_nationkey").cast("bigint").alias("shred_version"), _stake("c_acctbal").alias("stake"), (key % 97).alias("gossip_addr"), F.when(key % 5 != 0, key * 10).alias("tpu"))


def leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slot"), F.col("o_custkey").alias("leader"))


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pubkey"), F.col("s_nationkey").cast("bigint").alias("shred_version"), _stake("s_acctbal").alias("stake"))


def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control-plane observations: which input was seen at which slot."""
    slot = F.floor(F.col("event_id") / 4).cast("bigint")
    kind = F.col("event_type")
    name = F.when(kind == "view", "recent_blockhash").when(kind == "click", "cluster_topology").when(kind == "signup", "leader_schedule").otherwise("slot_status")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), slot.alias("slot"), name.alias("input"), (slot - F.floor("value").cast("bigint") % 3 * 32).alias("watermark_slot"))


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "v_shred": shreds,
    "v_slot": slots,
    "v_tx": transactions,
    "v_event": events,
    "v_update": updates,
    "v_gossip": replicated,
    "v_node": nodes,
    "v_leader": leaders,
    "v_peer": peers,
    "v_control": control,
}
