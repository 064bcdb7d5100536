"""Type-length-value records, base58 columns and byte comparisons."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotstream.functions import codec, wire


def u32(value: Column) -> Column:
    return wire.le_bytes(value, 4)


def u64(value: Column) -> Column:
    return wire.le_bytes(value, 8)


def text(value: Column) -> Column:
    """A string value: its length in 64 bits, then its bytes."""
    body = F.encode(value, "UTF-8")
    return F.concat(u64(F.octet_length(body)), body)


def record(kind: int, value: Column) -> Column:
    """One record: type, compact length (of values under 128 bytes, or under 16,384), value."""
    n = F.octet_length(value)
    short = wire.le_bytes(n, 1)
    longer = F.concat(wire.le_bytes(n % 128 + 128, 1), wire.le_bytes(F.floor(n / 128), 1))
    return F.concat(wire.le_bytes(F.lit(kind), 1), F.when(n < 128, short).otherwise(longer), value)


def split(payload: bytes) -> list[tuple[int, bytes]]:
    """(type, value) of all records; raises where the payload is cut off."""
    out, at = [], 0
    while at < len(payload):
        kind = payload[at]
        size, at = codec.compact_length(payload, at + 1)
        if at + size > len(payload):
            raise EOFError("value is cut off")
        out.append((kind, payload[at : at + size]))
        at += size
    return out


def decoded(kind: int, value: bytes) -> tuple[str, object] | None:
    """(field, value) of a record of a known type; None for an unknown type or a malformed value.

    Bytes behind a value are allowed, as the sender's type may have grown.
    """
    if kind == 1 and len(value) >= 8:
        return "number", int.from_bytes(value[:8], "little")
    if kind == 2 and len(value) >= 8:
        size = int.from_bytes(value[:8], "little")
        if len(value) >= 8 + size:
            try:
                return "name", value[8 : 8 + size].decode()
            except UnicodeDecodeError:
                return None
    return None


def parsed(frame: DataFrame, payload: str) -> DataFrame:
    """``frame`` with number and name (the last of each), and how many records were ``ignored``; a cut payload has none."""
    keep = [c for c in frame.columns if c != payload]
    schema = T.StructType([frame.schema[c] for c in keep] + T.StructType.fromDDL("number bigint, name string, ignored int").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            number, name, ignored = [], [], []
            for raw in b.column(b.schema.get_field_index(payload)).to_pylist():
                try:
                    found = [decoded(k, v) for k, v in split(raw or b"")]
                except (EOFError, ValueError):
                    found = []
                fields = dict(x for x in found if x)
                number.append(fields.get("number"))
                name.append(fields.get("name"))
                ignored.append(sum(x is None for x in found))
            arrays = [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array(number, pa.int64()), pa.array(name, pa.string()), pa.array(ignored, pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "number", "name", "ignored"])

    return frame.mapInArrow(run, schema)


def memcmp(data: Column, offset: int, base58: str) -> Column:
    """True where the bytes given in base58 stand at ``offset``."""
    raw = codec.base58_decode(base58)
    return F.substring(data, offset + 1, len(raw)) == F.lit(raw)


def base58(raw: Column) -> Column:
    """Bytes as base58 text."""

    @F.pandas_udf("string")
    def encode(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else codec.base58_encode(bytes(x)))

    return encode(raw)


def base58_bytes(texts: Column, size: int) -> Column:
    """(bytes, error) of base58 texts that must have ``size`` bytes (32 for keys, 64 for signatures)."""

    @F.pandas_udf("bytes binary, error string")
    def decode(values: pd.Series) -> pd.DataFrame:
        rows = []
        for x in values:
            try:
                rows.append((None if x is None else codec.base58_decode(x, size), None))
            except ValueError as e:
                rows.append((None, str(e)))
        return pd.DataFrame(rows, columns=["bytes", "error"])

    return decode(texts)
