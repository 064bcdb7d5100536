"""Quality classifier: supervised subword embeddings.

Hashed words, word pairs and byte n-grams have learned vectors; a document is the average of its
features' vectors, a softmax layer reads it, and numpy stochastic gradient descent learns both.
A word that repeats the one before it gives one shared pair feature.

Because the output is linear in the average, scoring needs only each feature's share of the logit.

Learning uses at most ``TRAIN_DOCS`` labelled texts (whole texts, those with the smallest hash of
their id).  Defined cases: a null or empty text scores by the bias alone; without labels every
text scores 0.5; an input column named like a result column gives way to the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotstream.llm import base
from slotstream.llm.vector import SPACES, U64, Packed, Words, byte_values, mix

ORDERS = (2, 3, 4)
#: Words, word pairs and each order of byte n-grams.
KINDS = 2 + len(ORDERS)
BITS, DIM, EPOCHS, TRAIN_DOCS = 15, 8, 8, 3000
#: Scores from here on predict label 1.
LEAST_SCORE = 0.3
ADDED = "score double, predicted int"


def features(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of feature: the text of each occurrence (rising) and its bucket."""
    packed = Packed(texts, b"\n")
    words = Words(packed, ~SPACES)
    h = words.hashes(lower=False)
    doc = np.repeat(np.arange(packed.n), words.count)
    out = [(doc, _bucket(h, 1))]
    if len(h) > 1:
        again = h[1:] == h[:-1]
        pair = np.where(again, U64(12345), h[:-1] * U64(3) + h[1:])
        same = doc[1:] == doc[:-1]
        out.append((doc[1:][same], _bucket(pair[same], 2)))
    values = byte_values(lower=False)[packed.buf]
    rows = np.repeat(np.arange(packed.n), packed.stop - packed.start + 1)
    total = np.zeros(len(values), U64)
    for k in range(max(ORDERS)):
        total = total[: len(values) - k] + values[k:] * U64(2 * k + 1) if len(values) > k else total[:0]
        if k + 1 in ORDERS:
            inside = np.arange(len(total)) + k < packed.stop[rows[: len(total)]]
            out.append((rows[: len(total)][inside], _bucket(total[inside], 3 + k)))
    return out


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    return (mix(h + U64(kind * 0x9E3779B9)) >> U64(64 - BITS)).astype(np.int64)


def counted(texts: list[bytes | None]) -> dict[str, object]:
    """Distinct buckets and their weights in each text's average, packed; every kind of feature weighs alike."""
    kinds = features(texts)
    doc, bucket = np.concatenate([d for d, _ in kinds]), np.concatenate([b for _, b in kinds])
    weight = np.concatenate([1 / np.bincount(d, minlength=len(texts))[d] for d, _ in kinds])
    both, place = np.unique((doc << BITS) + bucket, return_inverse=True)
    share = (np.bincount(place, weight, len(both)) / KINDS).astype(np.float32)
    at = np.searchsorted(both >> BITS, np.arange(len(texts) + 1))
    ids = (both & ((1 << BITS) - 1)).astype(np.uint16)
    return {"ids": [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], "shares": [share[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]}


class Model:
    """Feature vectors and a two-way softmax over their average."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1):
        r = np.random.default_rng(seed)
        vectors = r.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        out[:, 1] = r.uniform(-1, 1, DIM)
        seen, seen_out, seen_bias = np.full((1 << BITS, 1), 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
        if len(labels):
            p = np.clip(labels.mean(), 0.01, 0.99)
            bias[:] = np.log([1 - p, p])
        two = len(set(labels.tolist())) == 2  # with one label only the bias is learned
        for _ in range(EPOCHS if two else 0):
            order = r.permutation(len(docs))
            for lo in range(0, len(order), 16):
                batch = order[lo : lo + 16]
                ids = np.concatenate([docs[i][0] for i in batch])
                share = np.concatenate([docs[i][1] for i in batch])
                row = np.repeat(np.arange(len(batch)), [len(docs[i][0]) for i in batch])
                hidden = np.stack([np.bincount(row, share * vectors[ids, k], len(batch)) for k in range(DIM)], axis=1)
                logit = hidden @ out + bias
                chance = np.exp(logit - logit.max(axis=1, keepdims=True))
                chance /= chance.sum(axis=1, keepdims=True)
                chance[np.arange(len(batch)), labels[batch]] -= 1  # the slope of the loss
                back = chance @ out.T
                used, place = np.unique(ids, return_inverse=True)
                slope = np.stack([np.bincount(place, share * back[row, k], len(used)) for k in range(DIM)], axis=1)
                seen[used] += (slope**2).mean(axis=1, keepdims=True)
                vectors[used] -= 0.3 * slope / np.sqrt(seen[used])
                slope_out, slope_bias = hidden.T @ chance, chance.sum(axis=0)
                seen_out += slope_out**2
                seen_bias += slope_bias**2
                out -= 0.1 * slope_out / np.sqrt(seen_out)
                bias -= 0.02 * slope_bias / np.sqrt(seen_bias)
        self.part = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32) * two
        self.bias = float(bias[1] - bias[0]) if len(labels) else 0.0

    def score(self, texts: list[bytes | None]) -> dict[str, object]:
        total = np.zeros(len(texts))
        for doc, bucket in features(texts):
            total += np.bincount(doc, self.part[bucket], len(texts)) / np.maximum(1, np.bincount(doc, minlength=len(texts)))
        score = 1 / (1 + np.exp(-(total / KINDS + self.bias)))
        return {"score": score, "predicted": (score >= LEAST_SCORE).astype(np.int32)}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Model:
    """Learn from the texts of ``labels`` (its rows with a 0/1 label; the caller leaves folds out)."""
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    sample = clean.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(most)
    rows = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(sample), id_col)
    got = base.with_columns(rows.select("__label", "__text"), "__text", "ids binary, shares binary", counted).select("__label", "ids", "shares").collect()
    got.sort(key=lambda r: (bytes(r.ids), r[0]))  # the order of learning doesn't depend on partitions
    return Model([(np.frombuffer(r.ids, np.uint16).astype(np.int64), np.frombuffer(r.shares, np.float32)) for r in got], np.array([r[0] for r in got], np.int64))


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.with_columns(docs, text_col, ADDED, lambda texts: shared.value.score(texts))
