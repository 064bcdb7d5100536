"""Erasure recovery: Reed-Solomon over GF(2^8), per erasure set."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: the field polynomial x^8 + x^4 + x^3 + x^2 + 1.
POLYNOMIAL = 0x11D


@lru_cache(maxsize=1)
def _logs() -> tuple[np.ndarray, np.ndarray]:
    exp, log = np.zeros(512, np.int64), np.zeros(256, np.int64)
    x = 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x <<= 1
        if x & 0x100:
            x ^= POLYNOMIAL
    return exp, log


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field, element by element."""
    exp, log = _logs()
    a, b = np.broadcast_arrays(np.asarray(a, np.int64), np.asarray(b, np.int64))
    return np.where((a == 0) | (b == 0), 0, exp[log[a] + log[b]]).astype(np.uint8)


def power(a: int, n: int) -> int:
    exp, log = _logs()
    return 1 if n == 0 else 0 if a == 0 else int(exp[log[a] * n % 255])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(multiply(a[:, :, None], b[None, :, :]), axis=1)


def inverse(m: np.ndarray) -> np.ndarray:
    """Inverse of a square matrix; raises if it has none."""
    exp, log = _logs()
    n = len(m)
    work = np.concatenate((m.astype(np.uint8), np.eye(n, dtype=np.uint8)), axis=1)
    for col in range(n):
        pivot = col + int(np.argmax(work[col:, col] != 0))
        if not work[pivot, col]:
            raise np.linalg.LinAlgError("singular")
        work[[col, pivot]] = work[[pivot, col]]
        work[col] = multiply(work[col], exp[255 - log[work[col, col]]])
        for row in range(n):
            if row != col and work[row, col]:
                work[row] ^= multiply(work[col], work[row, col])
    return work[:, n:]


@lru_cache(maxsize=64)
def encoder(n_data: int, n_total: int) -> np.ndarray:
    """Systematic code matrix: a Vandermonde matrix scaled so that the first rows are the identity."""
    vander = np.array([[power(r, c) for c in range(n_data)] for r in range(n_total)], np.uint8)
    return product(vander, inverse(vander[:n_data]))


def encode(data: list[bytes], n_code: int) -> list[bytes]:
    rows = np.stack([np.frombuffer(x, np.uint8) for x in data])
    return [r.tobytes() for r in product(encoder(len(data), len(data) + n_code)[len(data) :], rows)]


@lru_cache(maxsize=4096)
def _decoder(use: tuple[int, ...], missing: tuple[int, ...], n_data: int, n_total: int) -> np.ndarray:
    """The matrix that makes the missing data shards of the used ones; sets with one loss pattern share it."""
    matrix = encoder(n_data, n_total)
    return product(matrix[list(missing)], inverse(matrix[list(use)]))


def reconstruct(present: dict[int, bytes], n_data: int, n_code: int) -> dict[int, bytes]:
    """The missing data shards by place, if ``n_data`` shards are present; else nothing."""
    missing = tuple(i for i in range(n_data) if i not in present)
    if len(present) < n_data or not missing:
        return {}
    use = tuple(sorted(present)[:n_data])
    rows = np.stack([np.frombuffer(present[i], np.uint8) for i in use])
    back = product(_decoder(use, missing, n_data, n_data + n_code), rows)
    return {i: r.tobytes() for i, r in zip(missing, back, strict=True)}


def _solve(sets: list[tuple]) -> list[tuple]:
    """Missing shards of many sets (key, n_data, n_code, shards by place); sets with one loss pattern share a product."""
    alike: dict[tuple, list[tuple]] = {}
    for key, n_data, n_code, shards in sets:
        missing = tuple(i for i in range(n_data) if i not in shards)
        if missing and len(shards) >= n_data:
            use = tuple(sorted(shards)[:n_data])
            alike.setdefault((use, missing, n_data, n_code, len(shards[use[0]])), []).append((key, [shards[i] for i in use]))
    out = []
    for (use, missing, n_data, n_code, size), members in alike.items():
        rows = np.frombuffer(b"".join(x for _, parts in members for x in parts), np.uint8).reshape(len(members), n_data, size)
        matrix = _decoder(use, missing, n_data, n_data + n_code)
        back = np.bitwise_xor.reduce(multiply(matrix[None, :, :, None], rows[:, None, :, :]), axis=2)
        out += [(*key, p, back[g, k].tobytes()) for g, (key, _) in enumerate(members) for k, p in enumerate(missing)]
    return out


def recovered(shards: DataFrame) -> DataFrame:
    """(slot, fec_set, place, payload) of the data shards that each erasure set gives back.

    ``shards``: slot, fec_set, place (data first, then code), n_data, n_code, arrival, payload.  The
    first configuration of a set holds (by arrival), others are ignored.  Sets are dealt by key and
    stream through in order: one set (a few hundred shards by the format) and one batch are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        for pdf in batches:
            done = []
            for slot, fec, place, n_data, n_code, payload in zip(pdf.slot, pdf.fec_set, pdf.place, pdf.n_data, pdf.n_code, pdf.payload, strict=True):
                if now is None or now[0] != (slot, fec):
                    done += [now] if now else []
                    now = ((slot, fec), int(n_data), int(n_code), {})
                if (n_data, n_code) == now[1:3]:
                    now[3].setdefault(int(place), bytes(payload))
            yield pd.DataFrame(_solve(done), columns=["slot", "fec_set", "place", "payload"])
        yield pd.DataFrame(_solve([now] if now else []), columns=["slot", "fec_set", "place", "payload"])

    columns = ["slot", "fec_set", "place", "n_data", "n_code", "payload"]
    dealt = shards.repartition("slot", "fec_set").sortWithinPartitions("slot", "fec_set", "arrival").select(*columns)
    return dealt.mapInPandas(run, "slot bigint, fec_set bigint, place bigint, payload binary")
