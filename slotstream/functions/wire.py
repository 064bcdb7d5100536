"""Fixed-offset binary headers as column expressions (little-endian integers, typed errors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Packet sizes and field offsets (0-based) of the wire format.
DATA_PACKET, CODE_PACKET, DATA_HEADER = 1203, 1228, 88
VARIANT, SLOT, INDEX, VERSION, FEC_SET = 64, 65, 73, 77, 79
PARENT_OFFSET, FLAGS, SIZE = 83, 85, 86
NUM_DATA, NUM_CODING, POSITION = 83, 85, 87
#: High nibble of the variant byte -> (type, resigned).
VARIANTS = {0x60: ("Code", False), 0x70: ("Code", True), 0x90: ("Data", False), 0xB0: ("Data", True)}


def uint(packet: Column, offset: int, size: int) -> Column:
    """Unsigned little-endian integer of ``size`` bytes at ``offset``."""
    return F.conv(F.hex(_reversed(packet, offset, size)), 16, 10).cast("bigint")


def _reversed(packet: Column, offset: int, size: int) -> Column:
    return F.concat(*[F.substring(packet, offset + 1 + i, 1) for i in range(size - 1, -1, -1)])


def variant_type(byte: Column) -> Column:
    out = F.lit(None).cast("string")
    for nibble, (name, _) in VARIANTS.items():
        out = F.when(byte.bitwiseAND(0xF0) == nibble, name).otherwise(out)
    return out


def resigned(byte: Column) -> Column:
    return byte.bitwiseAND(0xF0).isin(*[n for n, (_, again) in VARIANTS.items() if again])


def most_data_size(byte: Column) -> Column:
    """Largest data size: the packet less 32 bytes, the proof entries and a second signature."""
    return DATA_PACKET - (32 + 20 * byte.bitwiseAND(0x0F) + F.when(resigned(byte), 64).otherwise(0))


def header(packet: Column) -> dict[str, Column]:
    """Fields of a packet's header by name, ``error`` among them."""
    variant = uint(packet, VARIANT, 1)
    kind = variant_type(variant)
    data, code = kind == "Data", kind == "Code"
    size, flags = uint(packet, SIZE, 2), uint(packet, FLAGS, 1)
    slot, offset = uint(packet, SLOT, 8), uint(packet, PARENT_OFFSET, 2)
    n_data, n_code, place = uint(packet, NUM_DATA, 2), uint(packet, NUM_CODING, 2), uint(packet, POSITION, 2)
    length = F.octet_length(packet)
    error = (
        F.when(length < DATA_HEADER, "too_short")
        .when(kind.isNull(), "unknown_variant")
        .when(data & (length < DATA_PACKET), "short_data")
        .when(code & (length < CODE_PACKET), "short_code")
        .when(data & ((size < DATA_HEADER) | (size > most_data_size(variant))), "bad_size")
        .when(code & ((n_data == 0) | (n_code == 0) | (place >= n_code)), "bad_coding")
    )
    ok = error.isNull()
    return {
        "type": F.when(ok, kind),
        "slot": F.when(ok, slot),
        "idx": F.when(ok, uint(packet, INDEX, 4)),
        "version": F.when(ok, uint(packet, VERSION, 2)),
        "fec_set": F.when(ok, uint(packet, FEC_SET, 4)),
        "parent_slot": F.when(ok & data & (offset > 0) & (offset <= slot), slot - offset),
        "tick": F.when(ok & data, flags.bitwiseAND(0x3F)),
        "data_complete": F.when(ok & data, flags.bitwiseAND(0x40) != 0),
        "last_in_slot": F.when(ok & data, flags.bitwiseAND(0xC0) == 0xC0),
        "size": F.when(ok & data, size),
        "error": error,
    }


def first_signature(transaction: Column) -> Column:
    """The first signature of serialized transaction bytes: null for none, or where bytes lack."""
    count = uint(transaction, 0, 1)
    return F.when((count >= 1) & (count < 128) & (F.octet_length(transaction) >= 65), F.substring(transaction, 2, 64))


def le_bytes(value: Column, size: int) -> Column:
    """Little-endian bytes of a non-negative integer (the encoder of :func:`uint`)."""
    digits = F.lpad(F.hex(value), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)]))
