"""Name -> query and name -> SQL for every registered query."""

from __future__ import annotations

from slotstream.plans import control, dispatch, forks, fragments, gossip, ingest, peers, replication, transactions, wire  # noqa: F401  (they register)
from slotstream.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
