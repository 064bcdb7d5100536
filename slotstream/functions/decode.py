"""JSON notifications onto typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The methods of the three notifications.
METHODS = {"logsNotification": "logs", "transactionNotification": "transaction", "accountNotification": "account"}
SCHEMA = "method string, params struct<result: struct<context: struct<slot: bigint>, value: struct<err: string, logs: array<string>, data: array<string>>>>"


def notification(frame: DataFrame, message: str, most: int) -> DataFrame:
    """``frame`` with method, slot, failed, n_logs, payload and error of its JSON messages.

    A payload is base64; one of more than ``most`` bytes is an error, found by its encoded length
    before it is decoded.  What is no notification has the error ``not_a_notification``.
    """
    read = frame.withColumn("__m", F.from_json(message, SCHEMA))
    method = F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])
    kind = F.try_element_at(method, F.col("__m.method"))
    value = F.col("__m.params.result.value")
    data = F.when(kind.isin("transaction", "account"), F.get(value["data"], F.lit(0)))
    size = F.floor(F.length(data) * 3 / 4) - F.length(F.regexp_extract(data, "=*$", 0))
    error = F.when(kind.isNull(), "not_a_notification").when(size > most, "too_large")
    out = {
        "method": kind,
        "slot": F.when(kind.isNotNull(), F.col("__m.params.result.context.slot")),
        "failed": F.when(kind == "logs", value["err"].isNotNull()),
        "n_logs": F.when(kind == "logs", F.size(value["logs"])),
        "payload": F.when(error.isNull(), F.unbase64(data)),
        "error": error,
    }
    return read.withColumns(out).drop("__m", message)
