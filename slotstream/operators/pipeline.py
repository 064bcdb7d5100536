"""The packet path as one plan: verify, deduplicate, complete erasure sets, give out data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotstream.functions import wire
from slotstream.operators import recovery, verify


def processed(packets: DataFrame, leaders: DataFrame, known: list[bytes] = (), strict: bool = False) -> DataFrame:
    """(slot, fec_set, idx, recovered, data) of all data shards: those received, and those their erasure set gives back.

    ``packets``: arrival, ms, packet.  Only accepted packets count, the first of each place.  ``data``
    are a data packet's bytes behind the signature up to the proof; recovered ones have no signature.
    """
    status = verify.verified(packets, leaders, known, strict=strict).where(verify.accepted(F.col("status"), strict_unknown=strict))
    head = wire.header(F.col("packet"))
    parsed = status.select("arrival", "packet", *[head[n].alias(n) for n in ("type", "slot", "idx", "fec_set", "error")]).where("error is null")
    data = F.col("type") == "Data"
    end = F.when(data, wire.DATA_PACKET).otherwise(wire.CODE_PACKET) - 20 * wire.uint(F.col("packet"), wire.VARIANT, 1).bitwiseAND(0x0F)
    start = F.when(data, 64).otherwise(wire.DATA_HEADER + 1)
    number = lambda at: F.when(~data, wire.uint(F.col("packet"), at, 2))
    shards = parsed.select(
        "slot", "fec_set", "arrival", F.when(data, F.col("idx") - F.col("fec_set")).otherwise(number(wire.NUM_DATA) + number(wire.POSITION)).alias("place"),
        number(wire.NUM_DATA).alias("n_data"), number(wire.NUM_CODING).alias("n_code"), F.substring("packet", start + 1, end - start).alias("payload"),
    )
    shards = shards.groupBy("slot", "fec_set", "place").agg(F.min_by(F.struct("arrival", "n_data", "n_code", "payload"), "arrival").alias("s")).select("slot", "fec_set", "place", "s.*")
    # The first code packet of a set says how many shards it has.
    shape = shards.where("n_data is not null").groupBy("slot", "fec_set").agg(F.min_by(F.struct("n_data", "n_code"), "arrival").alias("shape"))
    whole = shards.drop("n_data", "n_code").join(shape, ["slot", "fec_set"], "left").select("slot", "fec_set", "place", "arrival", "payload", "shape.n_data", "shape.n_code")
    given = whole.where(F.col("n_data").isNull() | (F.col("place") < F.col("n_data"))).select("slot", "fec_set", (F.col("fec_set") + F.col("place")).alias("idx"), F.lit(False).alias("recovered"), F.col("payload").alias("data"))
    back = recovery.recovered(whole.where("n_data is not null")).select("slot", "fec_set", (F.col("fec_set") + F.col("place")).alias("idx"), F.lit(True), "payload")
    return given.union(back)
