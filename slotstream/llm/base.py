"""What the operators of this subpackage share: written tables, sized joins, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotstream.operators.shared import written

__all__ = ["written"]

#: Bytes that one side of a join may have to be broadcast (values, and ROW_BYTES a row); above it the join shuffles.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 32
#: Bytes of text that a Python worker holds as arrays at once (a longer single text stands alone).
CHUNK_BYTES = 1 << 19
#: Texts of a chunk, however short they are.
CHUNK_ROWS = 2048
#: Bytes of one Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20


def value_bytes(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.NumericType, T.BooleanType)):
        return F.coalesce(F.size(column), F.lit(0)) * 8
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(column.cast("string")), F.lit(0)) * 2
    if isinstance(kind, T.StructType):
        return sum((value_bytes(column[f.name], f.dataType) for f in kind.fields), F.lit(0))
    return F.lit(8)


def sized(df: DataFrame, share: int = 1) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if its measured size proves it small, else as it is.

    Small is at most ``BROADCAST_BYTES`` over ``share``: the driver holds a table several times over
    while it builds, keeps and serves it.
    """
    width = sum((value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES))
    size = df.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES // share else df


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` hasn't."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def without(df: DataFrame, names: list[str]) -> list[str]:
    """The columns of ``df`` but for those named like one of ``names`` in any case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % parts


def extended(schema: T.StructType, added: str | T.StructType) -> T.StructType:
    """``schema`` with ``added`` fields; an input column of the same name gives way."""
    new = T.StructType.fromDDL(added) if isinstance(added, str) else added
    names = {n.lower() for n in new.names}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + new.fields)


def with_columns(df: DataFrame, text_col: str, added: str, score: Callable[[list[bytes | None]], dict[str, object]]) -> DataFrame:
    """Append the columns ``added`` that ``score`` computes from whole texts, chunk by chunk.

    ``score`` gets a list of UTF-8 texts (None for null) of about ``CHUNK_BYTES`` together and
    returns, by column name, a value for each text.  Other columns pass through.
    """
    small_batches(df.sparkSession)
    schema = extended(df.schema, added)
    new = T.StructType.fromDDL(added).names
    keep = [n for n in schema.names if n not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary())
            for lo, hi in column_chunks(texts):
                part = batch.slice(lo, hi - lo)
                out = score(texts.slice(lo, hi - lo).to_pylist())
                arrays = [part.column(part.schema.get_field_index(n)) for n in keep]
                arrays += [pa.array(out[n], type=arrow_type(schema[n].dataType)) for n in new]
                yield pa.RecordBatch.from_arrays(arrays, names=keep + new)

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES``, unless the session has chosen a size other than Spark's default of 64 MB."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("67108864b", "64m"):
        spark.conf.set(key, f"{BATCH_BYTES}b")


def column_chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """The ranges of :func:`chunks` for a binary column, without copying it out of Arrow."""
    lo = size = 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if i > lo and (size + n > CHUNK_BYTES or i - lo >= CHUNK_ROWS):
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type of the few result types used here."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[kind.simpleString()]


def chunks(texts: list[bytes | None], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts together stay under ``most`` bytes (a longer one stands alone)."""
    lo = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if i > lo and (size + n > most or i - lo >= CHUNK_ROWS):
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)
