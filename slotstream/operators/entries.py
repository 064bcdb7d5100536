"""Entry streams: byte ranges of the transactions in a payload, by structure alone.

A payload is a 64-bit entry count, then entries of a 40-byte prefix, a 64-bit transaction count and
that many transactions.  All bytes must be used.  If decoding fails, leading fragments are dropped
one at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from slotstream.functions.codec import compact_length

PREFIX, KEY, SIGNATURE = 40, 32, 64


def _u64(data: bytes, at: int) -> tuple[int, int]:
    if at + 8 > len(data):
        raise EOFError("integer is cut off")
    return struct.unpack_from("<Q", data, at)[0], at + 8


def _skip(data: bytes, at: int, size: int) -> int:
    if at + size > len(data):
        raise EOFError("bytes are cut off")
    return at + size


def skip_transaction(data: bytes, at: int) -> int:
    """Offset after the transaction at ``at``: signatures, header, keys, blockhash, instructions, lookups."""
    n, at = compact_length(data, at)
    at = _skip(data, at, SIGNATURE * n)
    versioned = at < len(data) and bool(data[at] & 0x80)
    if versioned:
        if data[at] & 0x7F:
            raise ValueError("unknown message version")
        at += 1
    at = _skip(data, at, 3)
    n, at = compact_length(data, at)
    at = _skip(data, at, KEY * (n + 1))
    n, at = compact_length(data, at)
    for _ in range(n):
        at = _skip(data, at, 1)
        for _ in range(2):
            m, at = compact_length(data, at)
            at = _skip(data, at, m)
    if versioned:
        n, at = compact_length(data, at)
        for _ in range(n):
            at = _skip(data, at, KEY)
            for _ in range(2):
                m, at = compact_length(data, at)
                at = _skip(data, at, m)
    return at


def ranges(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of each transaction; raises unless the payload decodes to its last byte."""
    n, at = _u64(data, 0)
    out = []
    for _ in range(n):
        at = _skip(data, at, PREFIX)
        m, at = _u64(data, at)
        for _ in range(m):
            start, at = at, skip_transaction(data, at)
            out.append((start, at))
    if at != len(data):
        raise ValueError("bytes are left over")
    return out


def prefix_ranges(data: bytes) -> tuple[list[tuple[int, int]], str]:
    """Complete transactions of a growing payload, and Complete, Incomplete or Malformed."""
    out: list[tuple[int, int]] = []
    try:
        n, at = _u64(data, 0)
        for _ in range(n):
            at = _skip(data, at, PREFIX)
            m, at = _u64(data, at)
            for _ in range(m):
                start, at = at, skip_transaction(data, at)
                out.append((start, at))
    except EOFError:
        return out, "Incomplete"
    except ValueError:
        return out, "Malformed"
    return out, "Complete" if at == len(data) else "Malformed"


def from_fragments(fragments: list[bytes]) -> tuple[list[tuple[int, int]], bytes, int] | None:
    """(ranges, payload, fragments skipped) of the longest suffix of fragments that decodes."""
    for skipped in range(len(fragments)):
        payload = b"".join(fragments[skipped:])
        try:
            return ranges(payload), payload, skipped
        except (EOFError, ValueError):
            continue
    return None


def transaction_ranges(frame: DataFrame, key: str = "slot", fragments: str = "fragments") -> DataFrame:
    """(key, ordinal, start, end, skipped, signature) of each transaction in arrays of fragments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, parts in zip(pdf[key], pdf[fragments], strict=True):
                found = from_fragments([bytes(p) for p in parts])
                for i, (a, b) in enumerate(found[0] if found else []):
                    rows.append((k, i, a, b, found[2], found[1][a + 1 : a + 65] if found[1][a] else None))
            yield pd.DataFrame(rows, columns=[key, "ordinal", "start", "end", "skipped", "signature"])

    return frame.select(key, fragments).mapInPandas(run, f"{key} bigint, ordinal bigint, start bigint, end bigint, skipped bigint, signature binary")
