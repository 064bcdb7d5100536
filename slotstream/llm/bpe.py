"""BPE encoding and decoding over a distinct-word table.

Texts are split into words (the byte-level pre-tokenizer's pieces) in Spark, each distinct word of
the corpus is encoded once with the given tokenizer, and the ids are joined back by position:

* while the word table has at most ``broadcast_words`` rows it is broadcast as three flat arrays
  and each batch of texts joins it by binary search on a 64-bit word hash (proved free of
  collisions when the table is built);
* above that, documents are dealt into buckets of ``BUCKET_BYTES`` of text, the distinct
  (bucket, word) pairs join the table by shuffle, and each bucket meets its own part of the table.

Decoding joins ids with the id-to-piece table, whose size is the vocabulary's.

Defined cases: a null or empty text has no tokens and decodes to the empty text; special tokens'
strings in a text become their ids; repeated documents each get their own row; an input column
named like a result column gives way to the result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotstream.llm import base
from slotstream.llm.vector import U64, mix, powers

#: Rows of the word table that may be broadcast (about 25 bytes each in every Python worker).
BROADCAST_WORDS = 4_000_000
BUCKET_BYTES = 16 << 20
DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"

_LETTER, _NUMBER, _OTHER, _SPACE, _EDGE = range(5)
#: The code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """What is needed of a byte-level BPE file: special tokens, pieces by id, and the file itself."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.source = f.read()
        spec = json.loads(self.source)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        names = {i: w for w, i in spec["model"]["vocab"].items()} | {i: w for w, i in self.special.items()}
        byte_of = _byte_characters()
        pieces = [bytes(byte_of[c] for c in names[i]) if i in names else b"" for i in range(max(names) + 1)]
        self.piece_at = np.concatenate(([0], np.cumsum([len(x) for x in pieces]))).astype(np.int64)
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)


def _byte_characters() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
    table[WHITE_SPACE] = _SPACE
    return table


class Split:
    """Words of several texts: code-point ranges, hashes, the text of each word, special-token places."""

    def __init__(self, texts: list[bytes | None], special: dict[str, int], seed: int = 0):
        segments, doc, kind = [], [], []
        for d, x in enumerate(texts):
            for part, token in _segments((x or b"").decode("utf-8", "replace"), special):
                segments.append(part)
                doc.append(d)
                kind.append(token)
        self.joined = "\0".join([*segments, ""])
        cp = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        edge = np.cumsum(np.fromiter((len(x) + 1 for x in segments), np.int64, len(segments))) - 1
        kinds = _classes()[cp]
        kinds[edge] = _EDGE
        start = np.flatnonzero(_word_starts(cp, kinds))
        segment = np.searchsorted(edge, start)
        token = np.asarray(kind, np.int64)[segment]
        first = np.ones(len(start), bool)
        first[1:] = segment[1:] != segment[:-1]
        keep = (token < 0) | first
        stop = np.minimum(np.append(start[1:], len(cp)), edge[segment])[keep]
        self.start, self.stop, self.token = start[keep], stop, token[keep]
        per_doc = np.bincount(np.asarray(doc, np.int64)[segment[keep]], minlength=len(texts))
        self.first = np.concatenate(([0], np.cumsum(per_doc)))
        up, down = powers(len(cp))
        sums = np.zeros(len(cp) + 1, U64)
        np.cumsum(mix(cp.astype(U64) + U64(1 + 0x9E3779B1 * (seed + 1))) * up[: len(cp)], out=sums[1:])
        self.hash = mix((sums[self.stop] - sums[self.start]) * down[self.start] + (self.stop - self.start).astype(U64))

    def distinct(self) -> tuple[np.ndarray, list[str]]:
        """Hash and text of each distinct ordinary word."""
        plain = np.flatnonzero(self.token < 0)
        h, at = np.unique(self.hash[plain], return_index=True)
        return h, [self.joined[self.start[i] : self.stop[i]] for i in plain[at]]


def _segments(text: str, special: dict[str, int]) -> Iterator[tuple[str, int]]:
    """The text cut at special tokens in one pass: (part, -1) for ordinary text, (token, its id) for a token."""
    lo = 0
    for found in _finder(tuple(special)).finditer(text) if special else ():
        yield text[lo : found.start()], -1
        yield found[0], special[found[0]]
        lo = found.end()
    yield text[lo:], -1


@lru_cache(maxsize=4)
def _finder(special: tuple[str, ...]) -> re.Pattern:
    """The leftmost special token, the longest of those that begin there."""
    return re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))


def _word_starts(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where words begin: runs of one class with one space before them, the last white space of a
    longer run apart, and English contractions after a word's end."""
    before = np.concatenate(([_EDGE], kind[:-1]))
    after = np.concatenate((kind[1:], [_EDGE]))
    gap = np.concatenate(([False], cp[:-1] == 0x20)) & (before == _SPACE)
    start = (kind != before) & (kind != _EDGE) & ~((kind < _SPACE) & gap)
    start |= (kind == _SPACE) & (after < _SPACE)
    quote = np.flatnonzero(start & (cp == 0x27))
    quote = quote[quote + 1 < len(cp)]
    one, two = cp[quote + 1], cp[np.minimum(quote + 2, len(cp) - 1)]
    size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
    for pair in ("re", "ve", "ll"):
        size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 3
    quote, size = quote[size > 0], size[size > 0]
    start[quote + 1] = False
    end = quote + size
    start[end] = kind[end] != _EDGE
    return start


class WordIds:
    """Flat lookup from word hash to ids; the last rows hold the special tokens."""

    def __init__(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray, special: dict[str, int]):
        """``h``: signed hashes in rising order; ``ids``: the ids of all words in that order."""
        if len(h) > 1 and (h[1:] == h[:-1]).any():
            raise HashCollision
        own = sorted(special.values())
        self.hash = h
        self.special = {i: len(h) + k for k, i in enumerate(own)}
        self.at = np.zeros(len(h) + len(own) + 1, np.int64 if len(ids) >> 31 else np.int32)
        np.cumsum(np.concatenate((size, np.ones(len(own), size.dtype))), out=self.at[1:])
        self.ids = np.concatenate((ids, np.array(own, ids.dtype)))

    def encode(self, split: Split) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and where each text's ids begin."""
        h, back = np.unique(split.hash.view(np.int64), return_inverse=True)
        place = np.minimum(np.searchsorted(self.hash, h), max(0, len(self.hash) - 1))[back]
        for i, row in self.special.items():
            place[split.token == i] = row
        size = (self.at[place + 1] - self.at[place]).astype(np.int64)
        ids = self.ids[_flat(self.at[place], size)].astype("<u4")
        ends = np.concatenate(([0], np.cumsum(size)))
        return ids, ends[split.first]


class HashCollision(Exception):
    """Two words share a hash under this seed."""


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each run of ``size`` elements."""
    shift = start - np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else start
    return np.repeat(shift, size) + np.arange(int(size.sum()))


def decoded(ids: np.ndarray, first: np.ndarray, vocabulary: Vocabulary) -> list[bytes]:
    """UTF-8 text of each run of ids; bytes that are no UTF-8 become U+FFFD."""
    size = vocabulary.piece_at[ids.astype(np.int64) + 1] - vocabulary.piece_at[ids]
    data = vocabulary.piece_bytes[_flat(vocabulary.piece_at[ids], size)].tobytes()
    ends = np.concatenate(([0], np.cumsum(size)))[first]
    return [data[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def digests(texts: list[bytes | None], words: WordIds, vocabulary: Vocabulary, seed: int) -> dict[str, object]:
    ids, first = words.encode(Split(texts, vocabulary.special, seed))
    runs = [hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in zip(first[:-1], first[1:], strict=True)]
    return {"n_tokens": np.diff(first), "ids_sha256": runs, "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded(ids, first, vocabulary)]}


def id_arrays(texts: list[bytes | None], words: WordIds, vocabulary: Vocabulary, seed: int) -> dict[str, object]:
    ids, first = words.encode(Split(texts, vocabulary.special, seed))
    return {"ids": [ids[a:b].astype(np.int32) for a, b in zip(first[:-1], first[1:], strict=True)]}


def distinct_words(docs: DataFrame, special: dict[str, int], text_col: str = "text") -> DataFrame:
    """One row for each distinct word of the corpus."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for lo, hi in base.chunks(texts):
                h, words = Split(texts[lo:hi], special).distinct()
                new = [w for x, w in zip(h.tolist(), words, strict=True) if x not in seen]
                seen.update(h.tolist())
                if len(seen) > 400_000:  # bounds the task's memory; the distinct below is exact
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string())], names=["word"])

    return docs.select(text_col).mapInArrow(split, "word string").distinct()


def encoded_words(words: DataFrame, vocabulary: Vocabulary, seed: int = 0) -> DataFrame:
    """(hash, ids) of each row of a distinct-word table; ids are little-endian unsigned 32-bit integers."""
    source = words.sparkSession.sparkContext.broadcast(vocabulary.source)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source.value)
        for batch in batches:
            rows = batch.column(0).to_pylist()
            for lo in range(0, len(rows), 5000):
                part = rows[lo : lo + 5000]
                ids = [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([pa.array(word_hashes(part, seed).view(np.int64)), pa.array(ids, pa.binary())], names=["hash", "ids"])

    return words.mapInArrow(encode, "hash bigint, ids binary")


def word_hashes(words: list[str], seed: int) -> np.ndarray:
    """The hash that :class:`Split` gives these words."""
    cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    size = np.fromiter((len(w) for w in words), np.int64, len(words))
    stop = np.cumsum(size)
    up, down = powers(len(cp) + 1)
    sums = np.zeros(len(cp) + 1, U64)
    np.cumsum(mix(cp.astype(U64) + U64(1 + 0x9E3779B1 * (seed + 1))) * up[: len(cp)], out=sums[1:])
    return mix((sums[stop] - sums[stop - size]) * down[stop - size] + size.astype(U64))


def _id_type(vocabulary: Vocabulary) -> type:
    return np.uint16 if len(vocabulary.piece_at) <= 1 << 16 else np.uint32


def _word_ids(table: pa.Table, vocabulary: Vocabulary) -> WordIds:
    """The lookup of one bucket's words."""
    h = table.column("hash").to_numpy()
    order = np.argsort(h)
    ids = [np.frombuffer(x, "<u4") for x in table.column("ids").take(pa.array(order)).to_pylist()]
    flat = np.concatenate(ids).astype(_id_type(vocabulary)) if ids else np.zeros(0, _id_type(vocabulary))
    return WordIds(h[order], np.fromiter(map(len, ids), np.int64, len(ids)), flat, vocabulary.special)


def _collected(table: DataFrame, vocabulary: Vocabulary) -> WordIds:
    """The lookup of all words: each range of hashes comes to the driver as three packed arrays."""
    kind = _id_type(vocabulary)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ids = _binary_values(b.column(1)).astype(kind)
                size = (np.diff(_offsets(b.column(1))) // 4).astype(np.uint32)
                h = np.asarray(b.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([int(h[0])]), *[pa.array([x.tobytes()], pa.binary()) for x in (h, size, ids)]], names=["lo", "hash", "size", "ids"])

    packed = table.repartitionByRange("hash").sortWithinPartitions("hash").mapInArrow(pack, "lo bigint, hash binary, size binary, ids binary")
    parts = []  # one range of hashes at a time, so that the JVM never holds the whole table
    for r in packed.toLocalIterator():
        parts.append((r.lo, *[np.frombuffer(x, t) for x, t in ((r.hash, np.int64), (r.size, np.uint32), (r.ids, kind))]))
    parts.sort(key=lambda x: x[0])
    flat = [np.concatenate([p[k] for p in parts] or [np.zeros(0, t)]) for k, t in ((1, np.int64), (2, np.uint32), (3, kind))]
    del parts
    return WordIds(*flat, vocabulary.special)


def _offsets(a: pa.BinaryArray) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(a.type) else np.int32
    return np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)


def _binary_values(a: pa.BinaryArray) -> np.ndarray:
    at = _offsets(a)
    return np.frombuffer(a.buffers()[2], np.uint8)[at[0] : at[-1]].view("<u4")


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", output: str = "ids", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``docs`` with ``ids`` (array of int), or with the ``digests`` n_tokens, ids_sha256, decoded_sha256."""
    vocabulary = Vocabulary(path or default_path())
    added, make = {"ids": ("ids array<int>", id_arrays), "digests": (DIGESTS, digests)}[output]
    words = base.written(distinct_words(docs, vocabulary.special, text_col), "words")
    context = docs.sparkSession.sparkContext
    shared_vocabulary = context.broadcast(vocabulary)
    for seed in range(8):
        table = base.written(encoded_words(words, vocabulary, seed), "word-ids")
        if table.count() > broadcast_words:
            if table.groupBy("hash").count().where("count > 1").limit(1).count():
                continue
            return _by_bucket(docs, table, text_col, added, make, shared_vocabulary, seed)
        try:
            shared = context.broadcast(_collected(table, vocabulary))
        except HashCollision:
            continue
        return base.with_columns(docs, text_col, added, lambda texts, seed=seed, shared=shared: make(texts, shared.value, shared_vocabulary.value, seed))
    raise HashCollision


def _dealt(docs: DataFrame, text_col: str) -> tuple[str, DataFrame]:
    """``docs`` with a bucket of about ``BUCKET_BYTES`` of text for each row, in a column of the returned name.

    The bucket is a hash of the row.  Equal rows that would fill a bucket by themselves are written
    once with numbers of their own and dealt by these, so that no group of copies meets in one task.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    name, key = base.fresh(docs, "bucket"), base.fresh(docs, "key")
    rows = docs.withColumn(key, F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, T.MapType)]))
    heavy = rows.groupBy(key).agg(F.sum(F.octet_length(text_col)).alias("size")).where(F.col("size") > BUCKET_BYTES).select(key)
    heavy = base.written(heavy, "heavy")
    bucket = lambda k: F.pmod(k, F.lit(buckets)).cast("bigint")
    dealt = rows.withColumn(name, bucket(F.col(key)))
    if heavy.limit(1).count():
        few = base.sized(heavy)
        spread = bucket(F.xxhash64(F.monotonically_increasing_id()))
        copies = base.written(rows.join(few, key, "left_semi").withColumn(name, spread), "copies")
        dealt = rows.join(few, key, "left_anti").withColumn(name, bucket(F.col(key))).unionByName(copies)
    return name, dealt.drop(key)


def _by_bucket(docs: DataFrame, table: DataFrame, text_col: str, added: str, make, shared_vocabulary, seed: int) -> DataFrame:
    """Each bucket of documents meets the ids of its own distinct words."""
    name, dealt = _dealt(docs, text_col)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.asarray(batch.column(0))
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for lo, hi in base.chunks(texts):
                split = Split(texts[lo:hi], shared_vocabulary.value.special, seed)
                plain = split.token < 0
                both = np.unique(np.stack([np.repeat(where[lo:hi], np.diff(split.first))[plain], split.hash[plain].view(np.int64)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["bucket", "hash"])

    used = dealt.select(name, text_col).mapInArrow(pairs, "bucket bigint, hash bigint").distinct().join(table, "hash")
    schema = base.extended(docs.schema, added)
    new = T.StructType.fromDDL(added).names

    def meet(texts: pa.Table, words: pa.Table) -> pa.Table:
        lookup = _word_ids(words.select(["hash", "ids"]), shared_vocabulary.value)
        body = texts.column(text_col).cast(pa.binary()).to_pylist()
        parts = [make(body[lo:hi], lookup, shared_vocabulary.value, seed) for lo, hi in base.chunks(body)]
        out = {n: pa.chunked_array([pa.array(p[n], type=base.arrow_type(schema[n].dataType)) for p in parts]) for n in new}
        return pa.table({n: out[n] if n in out else texts.column(n) for n in schema.names})

    return dealt.groupBy(name).cogroup(used.groupBy("bucket")).applyInArrow(meet, schema)


def decode(frame: DataFrame, path: str | None = None, ids_col: str = "ids", output: str = "decoded") -> DataFrame:
    """``frame`` with the text of the id array ``ids_col``; null ids give null, no ids the empty text."""
    shared = frame.sparkSession.sparkContext.broadcast(Vocabulary(path or default_path()))
    schema = base.extended(frame.schema, f"{output} string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            rows = [np.asarray(x if x is not None else [], np.int64) for x in ids.to_pylist()]
            first = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int64)
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            texts = [x.decode() if v else None for x, v in zip(decoded(flat, first, shared.value), ids.is_valid().to_pylist(), strict=True)]
            keep = [n for n in schema.names if n != output]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(n)) for n in keep], pa.array(texts, pa.string())], names=[*keep, output])

    return frame.mapInArrow(run, schema)
