"""Language identification by error-correcting output codes.

Each language has a codeword of bits; one linear classifier over hashed byte n-grams predicts each
bit, and loss-weighted decoding takes the language whose codeword loses least.  A text whose two
best languages lie close is flagged ambiguous.

Learning uses at most ``TRAIN_DOCS`` labelled texts (whole texts, spread over the languages, those
with the smallest hash of their id); counts per language cover all labelled texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without a single
labelled text every text is ``und``; with one language every text with a letter gets it; an input
column named like a result column gives way to the result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotstream.llm import base
from slotstream.llm.vector import U64, Packed, byte_values, mix

ORDERS = (1, 2, 3)
#: log2 of the number of hashed n-gram features.
BITS = 13
TRAIN_DOCS = 2400
ADDED = "lang_pred string, score double, ambiguous boolean"
#: Least gap of normalised decoding loss between the two best languages of a clear decision.
CLEAR_GAP = 0.05
_BLOCK = 128


def ngram_frequencies(texts: list[bytes | None]) -> np.ndarray:
    """Square roots of the relative n-gram frequencies of each text, one row of 2**BITS each."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    for lo in range(0, len(texts), _BLOCK):
        packed = Packed(texts[lo : lo + _BLOCK], b"\n")
        values = byte_values(lower=True)[packed.buf]
        rows = np.repeat(np.arange(packed.n), packed.stop - packed.start + 1)
        counts = np.zeros(packed.n << BITS, np.int64)
        total = np.zeros(len(values), U64)
        for k in range(max(ORDERS)):
            total = total[: len(values) - k] + values[k:] * U64(2 * k + 1) if len(values) > k else total[:0]
            if k + 1 in ORDERS:
                inside = np.flatnonzero(np.arange(len(total)) + k < packed.stop[rows[: len(total)]])
                bucket = (mix(total[inside] + U64(k)) >> U64(64 - BITS)).astype(np.int64)
                counts += np.bincount((rows[inside] << BITS) + bucket, minlength=len(counts))
        each = counts.reshape(packed.n, -1)
        out[lo : lo + packed.n] = np.sqrt(each / np.maximum(1, each.sum(axis=1, keepdims=True)))
    return out


def has_letter(text: bytes | None) -> bool:
    return text is not None and any(map(str.isalpha, text.decode("utf-8", "replace")))


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """``n`` rows of +-1 bits: of many random codes, the one whose closest rows differ most."""
    if n == 2:
        return np.array([[1], [-1]])
    bits = max(7, 3 * int(np.ceil(np.log2(n))) + 3)
    r = np.random.default_rng(seed)
    best, most = None, (-1, -1)
    for _ in range(400):
        code = r.choice([-1, 1], (n, bits))
        if (np.abs(code.sum(axis=0)) == n).any():
            continue
        far = (bits - code @ code.T) // 2 + np.eye(n, dtype=int) * bits
        if (quality := (far.min(), -np.abs(code.sum(axis=0)).max())) > most:
            best, most = code, quality
    return best


class Model:
    """Codewords and one linear classifier for each bit, learned by gradient steps with momentum."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        if len(self.langs) < 2:
            return
        self.code = codewords(len(self.langs))
        y = self.code[[self.langs.index(k) for k in langs]].astype(np.float32)
        share = 1 / np.bincount([self.langs.index(k) for k in langs])[[self.langs.index(k) for k in langs]]
        weight = (share / share.sum()).astype(np.float32)[:, None]
        self.w, self.b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        step_w, step_b = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(200):
            slope = weight * -y / (1 + np.exp(y * (x @ self.w + self.b)))
            step_w = 0.9 * step_w - 6 * (x.T @ slope + 1e-5 * self.w)
            step_b = 0.9 * step_b - slope.sum(axis=0)
            self.w += step_w
            self.b += step_b
        right = (weight * (np.sign(x @ self.w + self.b) == y)).sum(axis=0)
        self.trust = np.maximum(1e-3, 2 * right - 1)
        self.trust /= self.trust.sum()

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted mean loss of each codeword for each row."""
        margin = x @ self.w + self.b
        return np.stack([np.logaddexp(0, -margin * c) @ self.trust for c in self.code], axis=1)

    def predict(self, texts: list[bytes | None]) -> dict[str, object]:
        lettered = [has_letter(t) for t in texts]
        if len(self.langs) < 2:
            only = self.langs[0] if self.langs else "und"
            return {"lang_pred": [only if k else "und" for k in lettered], "score": [float(k and bool(self.langs)) for k in lettered], "ambiguous": [False] * len(texts)}
        loss = np.concatenate([self.losses(ngram_frequencies(texts[lo : lo + _BLOCK])) for lo in range(0, len(texts), _BLOCK)])
        order = np.sort(loss, axis=1)
        odds = np.exp(-(loss - order[:, :1]) * self.code.shape[1])
        score = 1 / odds.sum(axis=1)
        best = loss.argmin(axis=1)
        return {
            "lang_pred": [self.langs[k] if ok else "und" for k, ok in zip(best, lettered, strict=True)],
            "score": [float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)],
            "ambiguous": [bool(ok and gap < CLEAR_GAP) for gap, ok in zip(order[:, 1] - order[:, 0], lettered, strict=True)],
        }


def training_sample(labelled: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled rows (20 a label at least), about as many of each label as there are, by the hash of the id."""
    counts = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect()}
    per = max(20, most // max(1, len(counts)))
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col(label_col) == F.lit(label), F.lit(per / n)).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(23)), F.lit(1_000_000))
    # The hash spreads the labels evenly, so that the last cut takes from all of them.
    picked = labelled.withColumn("__place", place / share).where(F.col("__place") < 1_000_000)
    return picked.orderBy("__place", F.xxhash64(F.col(id_col).cast("string"))).limit(per * max(1, len(counts))).drop("__place")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """Learn from rows with a text and a non-null language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))
    sample = training_sample(rows, id_col, "__lang", most)
    vectors = base.with_columns(sample.select("__lang", "__text"), "__text", "x binary", lambda t: {"x": [r.astype(np.float16).tobytes() for r in ngram_frequencies(t)]})
    got = vectors.select("__lang", "x").collect()
    x = np.frombuffer(b"".join(bytes(r.x) for r in got), np.float16).reshape(len(got), 1 << BITS).astype(np.float32)
    return Model(x, [r[0] for r in got])


def predicted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.with_columns(docs, text_col, ADDED, lambda texts: shared.value.predict(texts))
