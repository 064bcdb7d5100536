"""Ed25519 in plain Python (RFC 8032, strict checks), for Arrow batches; signing is for tests and fixtures."""

from __future__ import annotations

import hashlib
from functools import lru_cache

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
_ROOT = pow(2, (P - 1) // 4, P)


def _x_of(y: int, sign: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    if square == 0:
        return None if sign else 0
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * _ROOT % P
    if (x * x - square) % P:
        return None
    return P - x if x & 1 != sign else x


_BY = 4 * pow(5, P - 2, P) % P
_BX = _x_of(_BY, 0)
BASE = (_BX, _BY, 1, _BX * _BY % P)


def _add(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


def _point(raw: bytes) -> tuple | None:
    y = int.from_bytes(raw, "little")
    sign, y = y >> 255, y & ((1 << 255) - 1)
    x = _x_of(y, sign)
    return None if x is None else (x, y, 1, x * y % P)


@lru_cache(maxsize=1)
def _base_powers() -> list[tuple]:
    """The base point times 2**k."""
    out = [BASE]
    for _ in range(255):
        out.append(_add(out[-1], out[-1]))
    return out


def _times_base(n: int) -> tuple:
    out = (0, 1, 1, 0)
    for k, p in enumerate(_base_powers()):
        if n >> k & 1:
            out = _add(out, p)
    return out


def _bytes(p: tuple) -> bytes:
    z = pow(p[2], P - 2, P)
    x, y = p[0] * z % P, p[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    return a, h[32:]


def public_key(seed: bytes) -> bytes:
    return _bytes(_times_base(_secret(seed)[0]))


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    r = int.from_bytes(hashlib.sha512(prefix + message).digest(), "little") % ORDER
    top, own = _bytes(_times_base(r)), public_key(seed)
    k = int.from_bytes(hashlib.sha512(top + own + message).digest(), "little") % ORDER
    return top + ((r + k * a) % ORDER).to_bytes(32, "little")


def _small(p: tuple) -> bool:
    """True for a point whose order divides the cofactor, which strict checks refuse."""
    for _ in range(3):
        p = _add(p, p)
    return p[0] % P == 0 and (p[1] - p[2]) % P == 0


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """True if ``signature`` is a valid, canonical signature of ``message``."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= ORDER or _small(a) or _small(r):
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % ORDER
    left, right = _times_base(s), _add(r, _times(k, a))
    return not ((left[0] * right[2] - right[0] * left[2]) % P or (left[1] * right[2] - right[1] * left[2]) % P)
