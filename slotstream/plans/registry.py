"""Registration of queries: a Spark function over typed views, and the SQL it must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from slotstream.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The typed views once more, in the SQL of the cross-check.
VIEW_SQL = {
    "v_shred": """SELECT l_orderkey AS slot, CAST(l_linenumber - 1 AS BIGINT) AS idx, l_returnflag AS sig,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey) AS arrival,
  l_suppkey AS source, CAST(floor(l_quantity) AS BIGINT) AS payload_len, CAST((l_linenumber - 1) - ((l_linenumber - 1) % 4) AS BIGINT) AS fec_set,
  l_linestatus = 'F' OR l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS data_complete,
  l_linenumber = max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last_in_slot FROM lineitem""",
    "v_slot": "SELECT o_orderkey AS slot, CASE WHEN o_orderkey - (1 + o_custkey % 3) >= 0 THEN o_orderkey - (1 + o_custkey % 3) END AS parent_slot FROM orders",
    "v_tx": """SELECT o.o_orderkey AS slot, CAST(l.l_linenumber AS BIGINT) AS ix, l.l_partkey AS account, l.l_suppkey AS program_account,
  CASE l.l_returnflag WHEN 'R' THEN 'vote' WHEN 'N' THEN 'budget' ELSE 'other' END AS program, o.o_custkey AS payer, o.o_orderstatus = 'F' AS failed
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey""",
    "v_event": "SELECT event_id AS seq, ts, user_id AS source, event_type AS kind, value, props, CAST(floor(event_id / 4) AS BIGINT) AS slot FROM events",
    "v_update": """SELECT event_id AS seq, event_id % 3 AS source, CAST(CASE event_id % 3 WHEN 0 THEN 200 WHEN 1 THEN 300 ELSE 100 END AS BIGINT) AS priority,
  concat(event_type, ':', CAST(user_id AS VARCHAR)) AS logical_key FROM events""",
    "v_gossip": """SELECT concat(event_type, ':', CAST(user_id AS VARCHAR)) AS label, user_id AS pubkey, event_type AS kind, epoch_us(ts) // 1000 AS wallclock,
  md5(concat(CAST(event_id AS VARCHAR), props)) AS hash, event_id AS ordinal FROM events""",
    "v_node": """SELECT c_custkey AS pubkey, CAST(c_nationkey AS BIGINT) AS shred_version, CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal) AS BIGINT) ELSE 0 END AS stake,
  c_custkey % 97 AS gossip_addr, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 10 END AS tpu FROM customer""",
    "v_leader": "SELECT o_orderkey AS slot, o_custkey AS leader FROM orders",
    "v_peer": "SELECT s_suppkey AS pubkey, CAST(s_nationkey AS BIGINT) AS shred_version, CASE WHEN s_acctbal > 0 THEN CAST(floor(s_acctbal) AS BIGINT) ELSE 0 END AS stake FROM supplier",
    "v_control": """SELECT event_id AS seq, CAST(floor(event_id / 4) AS BIGINT) AS slot,
  CASE event_type WHEN 'view' THEN 'recent_blockhash' WHEN 'click' THEN 'cluster_topology' WHEN 'signup' THEN 'leader_schedule' ELSE 'slot_status' END AS input,
  CAST(floor(event_id / 4) AS BIGINT) - CAST(floor(value) AS BIGINT) % 3 * 32 AS watermark_slot FROM events""",
}


def query(sql: str | None = None, *, recursive: bool = False):
    """Register ``fn(*views)``; its parameters name the views or tables it reads."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        names = fn.__code__.co_varnames[: fn.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            load = lambda n: spark if n == "spark" else tables.VIEWS[n](spark, sf_dir) if n in tables.VIEWS else tables.table(spark, sf_dir, n)
            return fn(*[load(n) for n in names])

        run.__doc__, run.__name__ = fn.__doc__, fn.__name__
        QUERIES[fn.__name__] = run
        if sql:
            used = [f"{v} AS ({text})" for v, text in VIEW_SQL.items() if re.search(rf"\b{v}\b", sql)]
            head = sql.strip()
            if used:
                head = "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(used) + (",\n" + re.sub(r"^WITH\s+", "", head) if head.upper().startswith("WITH") else "\n" + head)
            elif recursive:
                head = re.sub(r"^WITH\s+", "WITH RECURSIVE ", head)
            ORACLE_SQL[fn.__name__] = head
        return fn

    return add
