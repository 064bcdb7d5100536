"""Benchmark decontamination: a broadcast hash set of test n-grams against all training token windows.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z.  A benchmark item gives its
windows of ``window`` consecutive words; an item of fewer words, but not none, is one window.
Document windows are looked up by a rolling 64-bit hash and every hit is verified word for word.

While its text stays under ``broadcast_bytes`` the whole set is broadcast as flat arrays (24 bytes a
window beside the text).  Above that only a bit filter of fixed size (``FILTER_BYTES``) is broadcast;
the document windows that pass it join the table of benchmark windows by shuffle, on hash and words.
Both ways give the same rows, whatever the type of the item ids, and both can cut spans.

Defined cases: a null or empty text has no words, is not hit and stays; an empty benchmark hits
nothing; items with a null id or text count for nothing; equal items all count, rows of one item id
count once; repeated documents each get their own row; an input column named like a result column
gives way to the result, any other passes through.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slotstream.llm import base
from slotstream.llm.vector import Packed, Words, alnum, by_text, covered, lowered, window_hashes, window_starts

WINDOW = 10
BROADCAST_BYTES = 16 << 20
#: Size of the filter of the shuffle path: 2**26 bits.
FILTER_BYTES = 1 << 23
_FILTER_BITS = 22
ADDED = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


def word_windows(texts: list[bytes | None]) -> Words:
    return Words(Packed(texts, b"\0"), alnum())


def plain(words: Words, i: int, length: int) -> bytes:
    """Words i..i+length-1, lowered and joined by one space."""
    buf = lowered()[words.packed.buf[words.start[i] : words.stop[i + length - 1]]]
    at = words.start[i]
    return b" ".join(buf[words.start[j] - at : words.stop[j] - at].tobytes() for j in range(i, i + length))


def places(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, hash) of all windows of packed item texts."""
    h = words.hashes(lower=True)
    length = np.minimum(words.count, window)
    out = []
    for n in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(window_starts(words.first, n) & np.repeat(length == n, words.count)[: max(0, len(h) - n + 1)])
        out.append((at, np.full(len(at), n), window_hashes(h, n)[at]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64))


class WindowSet:
    """Normalised windows as flat arrays in order of (length, hash): item, and place in the items' normalised words."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.names = list(dict.fromkeys(item for item, _ in items))
        number = {x: k for k, x in enumerate(self.names)}
        bodies, found, size = [], [], 0
        for lo, hi in base.chunks([x for _, x in items]):
            words = word_windows([x for _, x in items[lo:hi]])
            at, length, h = places(words, window)
            width = words.stop - words.start
            # Normalised text: every word of the chunk, lowered, with one space behind it.
            ends = np.cumsum(width + 1)
            begin = ends - width - 1 + size
            mask = np.zeros(len(words.packed.buf) + 1, bool)
            flags = alnum()[words.packed.buf]
            mask[:-1] = flags
            mask[words.stop] = True  # the byte behind a word becomes its space
            body = np.where(mask[:-1] & ~flags, np.uint8(32), lowered()[words.packed.buf])[mask[:-1]]
            doc = np.searchsorted(words.first, at, "right") - 1
            item = np.array([number[x] for x, _ in items[lo:hi]], np.int32)
            found.append((length.astype(np.int32), h, begin[at], (ends[at + length - 1] - 1 + size - begin[at]).astype(np.int32), item[doc]))
            bodies.append(body.tobytes())
            size += len(body)
        self.body = b"".join(bodies)
        empty = (np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        length, h, begin, width, item = (np.concatenate(x) for x in zip(*found, strict=True)) if found else empty
        order = np.lexsort((item, h, length))
        self.h, self.begin, self.width, self.item = h[order], begin[order], width[order], item[order]
        lengths, first = np.unique(length[order], return_index=True)
        self.spans = {int(n): (int(a), int(b)) for n, a, b in zip(lengths, first, [*first[1:], len(order)][: len(first)], strict=True)}
        self.filters = {n: self._filter(self.h[a:b]) for n, (a, b) in self.spans.items()}

    @staticmethod
    def _filter(hashes: np.ndarray) -> np.ndarray:
        bits = np.zeros(1 << _FILTER_BITS, bool)
        bits[hashes >> np.uint64(64 - _FILTER_BITS)] = True
        return np.packbits(bits)

    def hits(self, words: Words, h: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(word place, window length, numbers of the items) of each verified occurrence."""
        out = []
        for length, (a, b) in self.spans.items():
            known = self.h[a:b]
            w = window_hashes(h, length)
            at = passing(self.filters[length], w)
            at = at[window_starts(words.first, length)[at]]
            lo, hi = np.searchsorted(known, w[at]), np.searchsorted(known, w[at], "right")
            for i, x, y in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                said = plain(words, i, length)
                items = [int(self.item[k]) for k in range(a + x, a + y) if self.body[self.begin[k] : self.begin[k] + self.width[k]] == said]
                if items:
                    out.append((i, length, items))
        return out


def passing(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the packed bit filter lets through."""
    k = h >> np.uint64(64 - (len(bits).bit_length() + 2))
    return np.flatnonzero((bits[k >> np.uint64(3)] >> (np.uint8(7) - (k & np.uint64(7)).astype(np.uint8))) & 1)


def scanned(texts: list[bytes | None], windows: WindowSet) -> tuple[dict[str, object], np.ndarray, Words]:
    """Result columns of each text, the mask of hit words, and the words."""
    words = word_windows(texts)
    h = words.hashes(lower=True)
    hits = windows.hits(words, h)
    mask = covered(words.first, np.array([x[0] for x in hits], np.int64), np.array([x[1] for x in hits], np.int64))
    n_hit = by_text(mask.astype(np.int64), words.first)
    items: list[set[int]] = [set() for _ in texts]
    doc = np.searchsorted(words.first, [x[0] for x in hits], "right") - 1
    for d, (_, _, found) in zip(doc, hits, strict=True):
        items[d].update(found)
    ids = [",".join(sorted(str(windows.names[k]) for k in x)) for x in items]
    return (
        {"n_words": words.count.astype(np.int64), "n_hit": n_hit, "n_items": [len(x) for x in items], "items_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in ids], "contaminated": n_hit > 0},
        mask,
        words,
    )


def _items(benchmark: DataFrame, item_col: str, item_text: str, broadcast_bytes: int) -> tuple[DataFrame, bool]:
    """The usable rows (item, body) of the benchmark, and whether they may be broadcast."""
    items = benchmark.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text}`").cast("binary").alias("body")).where("item is not null and body is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    return items, size <= broadcast_bytes


def _shared(docs: DataFrame, items: DataFrame, window: int):
    return docs.sparkSession.sparkContext.broadcast(WindowSet([(x.item, bytes(x.body)) for x in items.collect()], window))


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated for each row."""
    items, small = _items(benchmark, item_col, item_text, broadcast_bytes)
    if small:
        shared = _shared(docs, items, window)
        return base.with_columns(docs, text_col, ADDED, lambda texts: scanned(texts, shared.value)[0])
    keep = base.without(docs, [*ADDED.replace(",", "").split()[::2]])
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{text_col}`").alias("body"))
    joined = _joined(base.with_columns(rows, "body", "n_words bigint", lambda texts: {"n_words": word_windows(texts).count.astype(np.int64)}), items, window)
    n_hit = F.coalesce(F.aggregate("runs", F.lit(0).cast("bigint"), lambda total, r: total + r["size"]), F.lit(0)).cast("bigint")
    named = F.coalesce("items", F.array().cast("array<string>"))
    out = {"n_words": F.col("n_words"), "n_hit": n_hit, "n_items": F.size(named).cast("bigint"), "items_sha256": F.sha2(F.array_join(named, ","), 256), "contaminated": n_hit > 0}
    return joined.select(*[F.col(f"doc.`{c}`") for c in keep], *[c.alias(n) for n, c in out.items()])


def _joined(rows: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """``rows`` (body and others) with ``items`` and ``runs`` (first word, size) of the hits, by shuffle.

    A text is known by two hashes and its length, so that equal texts are scanned once.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in base.chunks(texts):
                words = word_windows(texts[lo:hi])
                at, length, h = places(words, window)
                doc = np.searchsorted(words.first, at, "right") - 1 + lo
                bodies = [plain(words, i, n) for i, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc, pa.int64())), pa.array(length.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(bodies, pa.binary())], names=["item", "length", "h", "said"])

    base.small_batches(rows.sparkSession)
    kind = items.schema["item"].dataType.simpleString()
    table = base.written(items.mapInArrow(listed, f"item {kind}, length int, h bigint, said binary").distinct(), "windows")
    lengths = sorted(r.length for r in table.select("length").distinct().collect())
    # The filter: 64 bits a row, at most FILTER_BYTES / 8 rows.
    bits = 3 + FILTER_BYTES.bit_length() - 1
    place = F.shiftrightunsigned("h", 64 - bits)
    marks = table.groupBy(F.shiftrightunsigned(place, 6).alias("slot")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(63 - (shiftrightunsigned(h, {64 - bits}) & 63) as int))")).alias("mark")).toArrow()
    packed = np.zeros(FILTER_BYTES // 8, ">u8")
    packed[np.asarray(marks.column("slot"))] = np.asarray(marks.column("mark")).view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(packed.view(np.uint8))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in base.chunks(texts):
                words = word_windows(texts[lo:hi])
                h = words.hashes(lower=True)
                for n in lengths:
                    w = window_hashes(h, n)
                    at = passing(shared.value, w)
                    at = at[window_starts(words.first, n)[at]]
                    doc = np.searchsorted(words.first, at, "right") - 1
                    bodies = [plain(words, i, n) for i in at.tolist()]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc + lo, pa.int64())), pa.array(at - words.first[doc], pa.int64()), pa.array([n] * len(at), pa.int32()), pa.array(w[at].view(np.int64)), pa.array(bodies, pa.binary())], names=["key", "at", "length", "h", "said"])

    key = F.struct(F.xxhash64("body"), F.xxhash64(F.lit(1), "body"), F.coalesce(F.octet_length("body"), F.lit(0)))
    rows = rows.withColumn("key", key)
    texts = rows.select("key", F.col("body").cast("binary").alias("body")).where("body is not null")
    met = texts.mapInArrow(seen, f"key {rows.schema['key'].dataType.simpleString()}, at bigint, length int, h bigint, said binary").distinct()
    hit = base.written(met.join(table, ["length", "h", "said"]).select("key", "at", "length", "item"), "hits")
    items_of = hit.groupBy("key").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    # A text's hit words as runs: a run begins where no earlier window of the text reaches.
    text = Window.partitionBy("key").orderBy("at")
    spans = hit.groupBy("key", "at").agg(F.max(F.col("at") + F.col("length")).alias("stop"))
    spans = spans.withColumn("reach", F.max("stop").over(text.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("run", F.sum(F.when(F.col("reach").isNull() | (F.col("at") > F.col("reach")), 1).otherwise(0)).over(text))
    runs = spans.groupBy("key", "run").agg(F.min("at").alias("first"), F.max("stop").alias("stop")).groupBy("key")
    runs_of = runs.agg(F.sort_array(F.collect_list(F.struct("first", (F.col("stop") - F.col("first")).alias("size")))).alias("runs"))
    return rows.join(items_of, "key", "left").join(runs_of, "key", "left")


def _without_spans(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the byte ranges ``spans``, one space for each."""
    parts, lo = [], 0
    for a, b in spans:
        parts.append(raw[lo:a])
        lo = b
    return b" ".join([*parts, raw[lo:]]).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "document", text_col: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without benchmark passages: ``remove`` whole documents, or only the hit ``span``s of words.

    Spans keep the text before, between and after the hits; each removed run leaves one space.
    """
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col(f"`{text_col}`").alias("body"))
    if remove == "document":
        marked = contamination(rows, benchmark, "body", window=window, broadcast_bytes=broadcast_bytes)
        return marked.where("not contaminated").select("doc.*")
    if remove != "span":
        raise ValueError("remove is 'document' or 'span'")
    items, small = _items(benchmark, "item_id", "text", broadcast_bytes)
    if small:
        shared = _shared(docs, items, window)

        def cut(texts: list[bytes | None]) -> dict[str, object]:
            _, mask, words = scanned(texts, shared.value)
            out = []
            for d, text in enumerate(texts):
                own = mask[words.first[d] : words.first[d + 1]]
                edge = np.diff(np.concatenate(([0], own.view(np.int8), [0])))
                ranges = zip(np.flatnonzero(edge == 1) + words.first[d], np.flatnonzero(edge == -1) - 1 + words.first[d], strict=True)
                out.append(None if text is None else _without_spans(text, [(int(words.start[a] - words.packed.start[d]), int(words.stop[b] - words.packed.start[d])) for a, b in ranges]))
            return {"cut": out}

        done = base.with_columns(rows, "body", "cut string", cut)
    else:
        joined = _joined(rows, items, window)

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for text, runs in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                    words = word_windows([text])
                    out.append(None if text is None else _without_spans(text, [(int(words.start[r["first"]]), int(words.stop[r["first"] + r["size"] - 1])) for r in runs or []]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc", "cut"])

        done = joined.select("doc", "body", "runs").mapInArrow(apply, f"doc {rows.schema['doc'].dataType.simpleString()}, cut string")
    return done.select(*[F.col("cut").alias(n) if n.lower() == text_col.lower() else F.col(f"doc.`{n}`") for n in names])
