"""Runtime extensions: validated manifests, packet subscriptions and callbacks per micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotstream.operators import matching
from slotstream.plans.dispatch import MOST_BUFFER, SELECTORS

#: The capability that each kind of resource needs.
NEEDS = {"udp_listener": "bind_udp", "tcp_listener": "bind_tcp", "tcp_connector": "connect_tcp", "ws_connector": "connect_websocket"}


@dataclass(frozen=True)
class Resource:
    kind: str
    resource_id: str
    read_buffer_bytes: int = 4096
    shared_tag: str | None = None


@dataclass
class Extension:
    """Name, capabilities, resources, subscriptions (selector -> value) and the callback (packets, batch id)."""

    name: str
    callback: Callable[[DataFrame, int], None]
    capabilities: tuple[str, ...] = ()
    resources: tuple[Resource, ...] = ()
    subscriptions: list[dict[str, object]] = field(default_factory=list)


def faults(extension: Extension, allowed: set[str]) -> list[str]:
    """Everything that is wrong with a manifest under the policy's ``allowed`` capabilities."""
    out = [] if extension.name.strip() else ["empty name"]
    out += [f"capability {c} is not allowed" for c in extension.capabilities if c not in allowed]
    seen = set()
    for r in extension.resources:
        if not r.resource_id.strip():
            out.append("empty resource id")
        if r.resource_id in seen:
            out.append(f"duplicate resource id {r.resource_id}")
        seen.add(r.resource_id)
        if not 0 < r.read_buffer_bytes <= MOST_BUFFER:
            out.append(f"read buffer of {r.resource_id} is {r.read_buffer_bytes}")
        if r.shared_tag is not None and not r.shared_tag.strip():
            out.append(f"empty tag of {r.resource_id}")
        if NEEDS[r.kind] not in extension.capabilities:
            out.append(f"{r.resource_id} needs {NEEDS[r.kind]}")
    out += [f"unknown selector {s}" for x in extension.subscriptions for s in x if s not in SELECTORS]
    return out


class ExtensionHost:
    """Feeds each extension the packets that a subscription of its own matches and that it may see.

    Without ``strict`` an extension with a faulty manifest is left out, with its faults in
    ``rejected``; with it that is an error.
    """

    def __init__(self, extensions: list[Extension], allowed: set[str], strict: bool = False):
        names = [x.name for x in extensions]
        self.rejected = {x.name: faults(x, allowed) + (["duplicate name"] if names.count(x.name) > 1 else []) for x in extensions}
        self.rejected = {n: f for n, f in self.rejected.items() if f}
        if strict and self.rejected:
            raise ValueError(str(self.rejected))
        self.extensions = [x for x in extensions if x.name not in self.rejected]

    def matched(self, packets: DataFrame) -> DataFrame:
        """``packets`` (with the selectors as columns) with the array ``extensions`` of those that get them."""
        spark = packets.sparkSession
        kinds = {s: packets.schema[s].dataType.simpleString() for s in SELECTORS}
        rows = [tuple([x.name, "observe_ingress" in x.capabilities, "observe_shared" in x.capabilities, *[sub.get(s) for s in SELECTORS]]) for x in self.extensions for sub in x.subscriptions]
        table = spark.createDataFrame(rows, "__name string, __ingress boolean, __shared boolean, " + ", ".join(f"`{s}` {k}" for s, k in kinds.items()))
        marked = packets.withColumn("__packet", F.monotonically_increasing_id())
        met = matching.matched(marked, table, SELECTORS, ["__name", "__ingress", "__shared"])
        own = F.col("owner_extension").eqNullSafe(F.col("__name"))
        visible = own | (F.col("owner_extension").isNull() & F.col("__ingress")) | (F.col("shared_tag").isNotNull() & F.col("__shared"))
        taken = met.where(visible).groupBy("__packet", *packets.columns).agg(F.collect_set("__name").alias("extensions"))
        return taken.drop("__packet")

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""

        def run(batch: DataFrame, batch_id: int) -> None:
            shared = self.matched(batch).persist()
            try:
                for x in self.extensions:
                    x.callback(shared.where(F.array_contains("extensions", x.name)).drop("extensions"), batch_id)
            finally:
                shared.unpersist()

        return run
