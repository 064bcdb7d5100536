"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are words (digits, letters and all bytes over 0x7F, A-Z lowered) and the byte prefixes of
words in ``PREFIXES``.  A feature counts if it is more frequent in toxic than in other labelled
documents by a likelihood-ratio test (signed root at least ``LEAST_Z``) and its score is at least
``LEAST_WEIGHT`` (a large corpus makes the smallest difference significant); the score is the log-odds
of its document frequencies with a Dirichlet prior, split by the size of the two groups, less one
standard error.  A word scores by its longest feature that counts; every other word costs
``NEUTRAL``.  A linear-time scan finds all maximal-scoring segments of a text, and extreme-value
statistics turn their scores into the text's score: with Karlin-Altschul's lambda and K of the clean
documents, segments beyond chance are summed to x, and a logistic curve of log(1 + x), fitted on
labelled documents with and without a segment, maps that to 0..1.

Copies of one document are no independent evidence: of labelled documents of one class that share
a minimum hash of their 5-word shingles, only the smallest id counts (``COPY_KEYS`` minima, and a
document must be first for each of them).  Document frequencies cover all labelled texts beside
those copies, whatever the feature's frequency.  The model holds at most ``MOST_FEATURES``
features, the most significant ones.  The curve is fitted on at most ``CALIBRATION_DOCS`` labelled
texts, each scored as if it had not been counted.

Defined cases: a null or empty text has no segment and scores as a text without any toxic word;
without toxic labels every score is 0, without other labels no feature counts; rows of ``labels``
that share an id are one label (the larger); rows of ``docs`` that share an id are scored each by
their own text; rows with a null id are scored and never learned from; an empty table gives an
empty result; an input column named like a result column gives way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotstream.llm import base
from slotstream.llm.neardup import shingle_sets
from slotstream.llm.vector import U64, Packed, Words, alnum, mix

#: Byte lengths of the word prefixes that are features of their own, besides whole words.
PREFIXES = (4, 5, 6, 7, 8, 10)
#: Pseudo-documents that hold a feature: one, and PRIOR times its share of all documents.
PRIOR = 20.0
LEAST_Z, LEAST_WEIGHT, NEUTRAL = 4.5, 1.5, -0.15
MOST_FEATURES, CALIBRATION_DOCS, COPY_KEYS = 1_000_000, 20_000, 4
#: Candidate features whose hashes may go to the workers to thin out what they count (8 bytes each).
BROADCAST_FEATURES = 4_000_000
LEAST_SCORE = 0.7
ADDED = "score double, predicted int"
_LEVELS = len(PREFIXES) + 1


def read(texts: list[bytes | None]) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words, the running sums that hash their prefixes, and a hash of each word."""
    words = Words(Packed(texts, b"\n"), alnum())
    sums = words.prefix_sums(lower=True)
    return words, sums, mix(words.hashes(True, sums)).view(np.int64)


def features_of(words: Words, sums: np.ndarray, whole: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of feature hashes for each of the words ``at``: prefixes from short to long, then the word."""
    out = np.empty((len(at), _LEVELS), np.int64)
    start, stop = words.start[at], words.stop[at]
    for k, n in enumerate(PREFIXES):
        out[:, k] = mix(words.hashes(True, sums, np.minimum(start + n, stop), at) + U64(k + 1)).view(np.int64)
        out[stop - start <= n, k] = 0  # the word itself says it
    out[:, -1] = whole[at]
    return out


def segments(at: np.ndarray, score: np.ndarray, neutral: float = NEUTRAL) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first word, last word) of a text, in linear time.

    ``at``: places of the words with a positive score, ``score``: theirs; the words between cost
    ``neutral`` each.  The list of candidates holds cumulative totals left and right of each
    segment; a new one is joined to the last that began lower and ended lower.
    """
    found: list[list[float]] = []  # left total, right total, first, last
    total, last = 0.0, -1
    for i, s in zip(at.tolist(), score.tolist(), strict=True):
        total += neutral * (i - last - 1)
        now = [total, total + s, i, i]
        total, last = now[1], i
        while found:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= now[0]:
                j -= 1
            if j < 0 or found[j][1] >= now[1]:
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
        found.append(now)
    return [(r - left, int(a), int(b)) for left, r, a, b in found]


class Model:
    """Feature weights, segment statistics and the logistic curve."""

    def __init__(self, h: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int):
        order = np.argsort(h)
        self.h, self.toxic, self.clean, self.n = h[order], toxic[order].astype(float), clean[order].astype(float), (n_toxic, n_clean)
        weight = self._weights(0, 0)
        keep = weight > 0
        self.h, self.toxic, self.clean = self.h[keep], self.toxic[keep], self.clean[keep]
        self.weights = {None: weight[keep], 1: self._weights(1, 0), 0: self._weights(0, 1)}
        self.rate, self.scale, self.curve = 1.0, 0.1, (0.0, -30.0)

    def _weights(self, less_toxic: int, less_clean: int) -> np.ndarray:
        """Shrunken log-odds of each feature, 0 where it isn't significant; with documents left out."""
        x, y = np.maximum(0, self.toxic - less_toxic), np.maximum(0, self.clean - less_clean)
        nx, ny = max(1, self.n[0] - less_toxic), max(1, self.n[1] - less_clean)
        n = nx + ny
        prior = 1 + PRIOR * (x + y) / n
        a, b = x + prior * nx / n, y + prior * ny / n
        most = 1 + (1 + PRIOR) / n
        odds = np.log(a / (nx * most - a)) - np.log(b / (ny * most - b))
        ratio = x * np.log(np.maximum(x, 1e-9) / np.maximum(1e-9, (x + y) * nx / n)) + y * np.log(np.maximum(y, 1e-9) / np.maximum(1e-9, (x + y) * ny / n))
        weight = odds - np.sqrt(1 / a + 1 / b)
        counts = (x * ny > y * nx) & (2 * ratio >= LEAST_Z**2) & (weight >= LEAST_WEIGHT)
        return np.where(counts, weight, 0).astype(np.float32)

    def word_scores(self, words: Words, sums: np.ndarray, whole: np.ndarray, left_out: int | None = None) -> np.ndarray:
        """Score of each word by its longest feature that counts (0 if none does); equal words are looked up once."""
        out = np.zeros(len(whole), np.float32)
        if len(self.h) and len(whole):
            distinct, first, back = np.unique(whole, return_index=True, return_inverse=True)
            rows, best = features_of(words, sums, whole, first), np.zeros(len(distinct), np.float32)
            for k in range(_LEVELS):
                place = np.minimum(np.searchsorted(self.h, rows[:, k]), len(self.h) - 1)
                w = np.where(self.h[place] == rows[:, k], self.weights[left_out][place], 0)
                best = np.where(w > 0, w, best)
            out = best[back]
        return out

    def scan(self, texts: list[bytes | None], left_out: int | None = None) -> tuple[Words, np.ndarray, list[list[tuple[float, int, int]]]]:
        """Words, their scores, and the maximal-scoring segments of each text (words counted within the text)."""
        words, sums, whole = read(texts)
        score = self.word_scores(words, sums, whole, left_out)
        at = np.flatnonzero(score)
        edge = np.searchsorted(at, words.first)
        found = [segments(at[a:b] - words.first[d], score[at[a:b]]) if a < b else [] for d, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))]
        return words, score, found

    def passages(self, texts: list[bytes | None], left_out: int | None = None) -> tuple[Words, list[list[tuple[float, int, int]]]]:
        words, _, found = self.scan(texts, left_out)
        return words, found

    def beyond(self, n: int, found: list[tuple[float, int, int]]) -> float:
        """Sum over the text's significant segments of lambda S - log(K n); 0 where none is."""
        chance = math.log(self.scale * max(n, 1))
        return sum(max(0.0, self.rate * s - chance) for s, _, _ in found)

    def score(self, texts: list[bytes | None]) -> dict[str, object]:
        words, found = self.passages(texts)
        x = np.log1p(np.array([self.beyond(int(n), s) for n, s in zip(words.count, found, strict=True)], float))
        a, b = self.curve
        score = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30))) if self.n[0] else np.zeros(len(texts))
        return {"score": score, "predicted": (score >= LEAST_SCORE).astype(np.int32)}

    def set_chance(self, scores: np.ndarray, counts: np.ndarray, n: np.ndarray, best: np.ndarray) -> None:
        """Lambda and K of clean documents.

        ``scores``, ``counts``: the positive word scores and how often they occur there; ``n``,
        ``best``: each document's words and best segment.  One occurrence of the highest score is
        added, so that lambda stays finite where no clean word scores.
        """
        top = max(float(self.weights[None].max(initial=0)), 0.5)
        seen = float(counts.sum())
        p = np.concatenate(([max(1.0, n.sum() - seen), 1.0], counts))
        p, s = p / p.sum(), np.concatenate(([NEUTRAL, top], scores))
        lo, hi = 0.0, 20.0
        for _ in range(60):  # the root of sum p exp(lambda s) = 1
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(np.minimum(700, mid * s))).sum() < 1 else (lo, mid)
        self.rate = max(lo, 0.05)
        if len(n):
            high = np.sort(self.rate * best - np.log(np.maximum(1, n)))
            self.scale = float(np.clip(-math.log(0.95) * math.exp(high[int(0.95 * (len(high) - 1))]), 1e-6, 10))

    def set_curve(self, label: np.ndarray, x: np.ndarray) -> None:
        """The logistic curve over log(1 + x), by damped Newton steps."""
        z, w = np.stack([np.log1p(x), np.ones(len(x))], axis=1), np.zeros(2)
        loss = lambda w: np.logaddexp(0, -(2 * label - 1) * (z @ w)).sum() + 5e-3 * (w @ w)
        for _ in range(50 if len(x) else 0):
            q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope = z.T @ (q - label) + 1e-2 * w
            step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 1e-2 * np.eye(2), slope)
            while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                step /= 2
            w = w - step
        self.curve = (max(0.0, float(w[0])), float(w[1]))


def _once_per_text(texts: list[bytes | None]) -> np.ndarray:
    """The hash of each feature of each text, once per text."""
    words, sums, whole = read(texts)
    doc = np.repeat(np.arange(words.packed.n), words.count)
    order = np.lexsort((whole, doc))
    new = np.ones(len(order), bool)
    new[1:] = (whole[order[1:]] != whole[order[:-1]]) | (doc[order[1:]] != doc[order[:-1]])
    at = order[new]
    flat, doc = features_of(words, sums, whole, at).reshape(-1), np.repeat(doc[at], _LEVELS)
    flat, doc = flat[flat != 0], doc[flat != 0]
    order = np.lexsort((flat, doc))
    flat, doc = flat[order], doc[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    return flat[new]


def _document_frequency(texts: DataFrame, known=None) -> DataFrame:
    """(h, n): in how many texts each feature is; only the features of ``known`` if given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = b.column(0).cast(pa.binary())
            for lo, hi in base.column_chunks(body):
                h, n = np.unique(_once_per_text(body.slice(lo, hi - lo).to_pylist()), return_counts=True)
                if known is not None:
                    keep = np.isin(h, known.value, assume_unique=True)
                    h, n = h[keep], n[keep]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    base.small_batches(texts.sparkSession)
    return texts.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def _firsts(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, __label) of the labelled rows (id, __label, __text) that are no copy of a smaller id of their class.

    Aggregates only: no group of copies is gathered or joined.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            body = b.column(2).cast(pa.binary())
            for lo, hi in base.column_chunks(body):
                sets = shingle_sets(body.slice(lo, hi - lo).to_pylist())
                some = [i for i, s in enumerate(sets) if len(s)]
                for k in range(COPY_KEYS):
                    least = np.array([mix(sets[i] ^ U64(0x9E3779B97F4A7C15 * (k + 1) & (2**64 - 1))).min() for i in some], np.uint64).view(np.int64)
                    part = b.slice(lo, hi - lo).take(pa.array(some, pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([k] * len(some), pa.int32()), pa.array(least)], names=[id_col, "__label", "k", "key"])

    base.small_batches(rows.sparkSession)
    kind = rows.schema[id_col].dataType.simpleString()
    each = rows.select(id_col, "__label", "__text").mapInArrow(keys, f"`{id_col}` {kind}, __label int, k int, key bigint")
    first = each.groupBy("__label", "k", "key").agg(F.min(id_col).alias(id_col))
    place = first.groupBy(id_col, "__label").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("places"))
    return place.where(F.col("places") == (1 << COPY_KEYS) - 1).select(id_col, "__label")


def _features(rows: DataFrame, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all significant features, and in how many toxic and other texts of (__label, __text) they are.

    A feature in x toxic texts and no other has the ratio x log(n / n_toxic); what stays below
    ``LEAST_Z`` even so is left out of the second count, which loses nothing.
    """
    n = n_toxic + n_clean
    none = np.zeros(0, np.int64)
    if not n_toxic or not n_clean:
        return none, none, none
    least = math.ceil(LEAST_Z**2 / (2 * math.log(n / n_toxic)) - 1e-9)
    hopeful = base.written(_document_frequency(rows.where("__label = 1").select("__text")).where(F.col("n") >= least).withColumnRenamed("n", "x"), "toxic-features")
    known = None
    if hopeful.count() <= BROADCAST_FEATURES:
        known = rows.sparkSession.sparkContext.broadcast(np.sort(hopeful.select("h").toArrow().column(0).to_numpy()))
    other = _document_frequency(rows.where("__label = 0").select("__text"), known).withColumnRenamed("n", "y")
    both = hopeful.join(other, "h", "left").withColumn("y", F.coalesce("y", F.lit(0)))
    x, y, all_ = F.col("x"), F.col("y"), F.col("x") + F.col("y")
    ratio = x * F.ln(x * n / (all_ * n_toxic)) + F.when(y > 0, y * F.ln(y * n / (all_ * n_clean))).otherwise(0.0)
    strong = both.where((x * n_clean > y * n_toxic) & (2 * ratio >= LEAST_Z**2 - 1e-9))
    got = strong.orderBy(ratio.desc(), "h").limit(MOST_FEATURES).select("h", "x", "y").toArrow()
    return tuple(got.column(k).to_numpy() for k in ("h", "x", "y"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = CALIBRATION_DOCS) -> Model:
    """Learn from the texts of ``labels`` (its rows with a 0/1 label; the caller leaves folds out)."""
    context = docs.sparkSession.sparkContext
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("__label"))
    texts = docs.where(F.col(text_col).isNotNull()).select(id_col, F.col(text_col).alias("__text"))
    rows = texts.join(base.sized(base.written(clean, "labels")), id_col).select(id_col, "__label", "__text")
    firsts = base.written(_firsts(rows, id_col), "firsts")
    sizes = {r[0]: r[1] for r in firsts.groupBy("__label").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    model = Model(*_features(texts.join(base.sized(firsts), id_col), n_toxic, n_clean), n_toxic, n_clean)
    shared = context.broadcast(model)
    sample = firsts.orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(most)
    picked = texts.join(F.broadcast(sample), id_col).select("__label", "__text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label = np.asarray(b.column(0))
            body = b.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in base.chunks(body):
                for y in (0, 1):
                    own = [body[i] for i in np.flatnonzero(label[lo:hi] == y) + lo]
                    words, score, found = shared.value.scan(own, y)
                    ups = [np.unique(np.round(score[a:z][score[a:z] > 0].astype(float), 2), return_counts=True) for a, z in zip(words.first[:-1], words.first[1:], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([y] * len(own), pa.int32()),
                            pa.array(words.count.astype(np.int64)),
                            pa.array([[s for s, _, _ in f] for f in found], pa.list_(pa.float64())),
                            pa.array([u for u, _ in ups], pa.list_(pa.float64())),
                            pa.array([c for _, c in ups], pa.list_(pa.int64())),
                        ],
                        names=["label", "n", "segments", "up", "times"],
                    )

    seen = base.written(picked.mapInArrow(measure, "label int, n bigint, segments array<double>, up array<double>, times array<bigint>"), "measured")
    zipped = seen.where("label = 0").select(F.explode(F.arrays_zip("up", "times")).alias("u"))
    hist = zipped.groupBy(F.col("u.up").alias("up")).agg(F.sum("u.times").alias("times")).toArrow()
    tops = seen.where("label = 0").select("n", F.coalesce(F.array_max("segments"), F.lit(0.0)).alias("best")).toArrow()
    model.set_chance(*(np.asarray(t.column(c), float) for t, c in ((hist, "up"), (hist, "times"), (tops, "n"), (tops, "best"))))
    chance = F.ln(F.lit(model.scale) * F.greatest("n", F.lit(1)))
    x = F.aggregate("segments", F.lit(0.0), lambda total, s: total + F.greatest(F.lit(0.0), F.lit(model.rate) * s - chance))
    points = seen.select("label", x.alias("x")).toArrow()
    model.set_curve(np.asarray(points.column("label"), float), np.asarray(points.column("x"), float))
    return model


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return base.with_columns(docs, text_col, ADDED, lambda texts: shared.value.score(texts))


def toxic_passages(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with the significant toxic passages: texts, and segment scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def show(texts: list[bytes | None]) -> dict[str, object]:
        m = shared.value
        words, found = m.passages(texts)
        raw = words.packed.buf.tobytes()
        strong = [[(s, words.first[d] + a, words.first[d] + b) for s, a, b in f if m.rate * s - math.log(m.scale * max(1, int(words.count[d]))) > 0] for d, f in enumerate(found)]
        return {"passages": [[raw[words.start[a] : words.stop[b]].decode() for _, a, b in f] for f in strong], "passage_scores": [[float(s) for s, _, _ in f] for f in strong]}

    return base.with_columns(docs, text_col, "passages array<string>, passage_scores array<double>", show)
