"""Byte codecs in plain Python, for use inside Arrow batches: base58, compact lengths, slot runs."""

from __future__ import annotations

#: Fixed value: the base58 alphabet.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_VALUE = {c: i for i, c in enumerate(ALPHABET)}


def base58_encode(raw: bytes) -> str:
    number, out = int.from_bytes(raw, "big"), []
    while number:
        number, digit = divmod(number, 58)
        out.append(ALPHABET[digit])
    zeros = len(raw) - len(raw.lstrip(b"\0"))
    return "1" * zeros + "".join(reversed(out))


def base58_decode(text: str, size: int | None = None) -> bytes:
    """The bytes of a base58 text; ``size`` demands that many (32 for keys, 64 for signatures)."""
    number = 0
    for c in text:
        if c not in _VALUE:
            raise ValueError(f"no base58 character: {c!r}")
        number = number * 58 + _VALUE[c]
    zeros = len(text) - len(text.lstrip("1"))
    raw = b"\0" * zeros + number.to_bytes((number.bit_length() + 7) // 8, "big")
    if size is not None and len(raw) != size:
        raise ValueError(f"{len(raw)} bytes instead of {size}")
    return raw


def compact_length(data: bytes, at: int) -> tuple[int, int]:
    """(value, next offset) of a compact 16-bit length: seven bits a byte, three bytes at most."""
    value = 0
    for k in range(3):
        if at + k >= len(data):
            raise EOFError("length is cut off")
        byte = data[at + k]
        value |= (byte & 0x7F) << (7 * k)
        if not byte & 0x80:
            if value > 0xFFFF or (k and not byte):
                raise ValueError("no compact length")
            return value, at + k + 1
    raise ValueError("length over three bytes")


def compact_bytes(value: int) -> bytes:
    out = bytearray()
    while True:
        byte, value = value & 0x7F, value >> 7
        out.append(byte | (0x80 if value else 0))
        if not value:
            return bytes(out)


def runs_to_slots(first: int, runs: list[tuple[int, int]], least: int = 0) -> list[int]:
    """Slots of run-length pairs (skip, take) from ``first`` on, those from ``least`` on only."""
    out, at = [], first
    for skip, take in runs:
        at += skip
        out += [s for s in range(at, at + take) if s >= least]
        at += take
    return out
