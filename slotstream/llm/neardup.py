"""MinHash near-dedup with HyperMinHash sketches.

A document's set is its distinct 5-word shingles (with fewer words, the whole sequence as one).
Each set gives a sketch of ``BUCKETS`` registers of 16 bits: the leading-zero count (6 bits) of the
bucket's smallest hash and the ``MANTISSA`` bits behind it; an empty bucket takes the register of
the non-empty bucket that a fixed random order puts first.  Then:

1. equal sets collapse to their smallest doc_id (by a 128-bit fingerprint of the set);
2. ``BANDS`` bands of ``ROWS`` compressed registers are the keys of candidate buckets;
3. in each bucket the smallest id is compared with the others (a star, not all pairs): pairs whose
   collision-corrected Jaccard estimate is low are dropped, the rest are confirmed on full sets;
4. only where a bucket still spans several components are its remaining pairs across components
   compared, so that no link is lost to the choice of the star's centre; members whose own
   shingles rule out any further link drop out first;
5. components come from large-star and small-star steps over the confirmed links.

A true link of similarity 0.85 misses all bands with probability (1 - 0.85**6)**32, about 3e-7; one
of 0.8 with 6e-5.  A candidate's estimate is too low by five standard errors with about 3e-7.

Defined cases: a null, empty or blank text has the empty set and links with nothing; a null doc_id
has a null component and is kept; rows that share a doc_id are one node and stay together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotstream.llm import base
from slotstream.llm.graph import components
from slotstream.llm.vector import SPACES, U64, Packed, Words, mix, window_hashes

SHINGLE, BUCKETS, BANDS, ROWS, MANTISSA = 5, 192, 32, 6, 10
#: Links hold at 100 * intersection >= percent * union, by default this.
PERCENT = 85
#: Sets of one shingle that make it rare in the last comparison.
RARE = 8
#: Part of the broadcast bound that tables of ids, keys and components take here; beyond it they shuffle, as thin rows.
SHARE = 4
#: Rows with sketches that a Python worker works on at once (``BANDS`` keys come from each).
SLICE = 1024
_EMPTY = U64(2**64 - 1)


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(Packed(texts, b"\n"), ~SPACES)
    h = words.hashes(lower=True)
    full = window_hashes(h, shingle)
    out = []
    for a, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        out.append(np.unique(full[a : a + n - shingle + 1]) if n >= shingle else window_hashes(h[a : a + n], n) if n else h[:0])
    return out


@lru_cache(maxsize=1)
def _borrow_order() -> np.ndarray:
    return np.random.default_rng(11).random((BUCKETS, BUCKETS), np.float32)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``BUCKETS`` 16-bit registers for each set."""
    size = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, U64)
    bucket = ((flat >> U64(32)) * U64(BUCKETS)) >> U64(32)
    smallest = np.full(len(sets) * BUCKETS, _EMPTY, U64)
    np.minimum.at(smallest, np.repeat(np.arange(len(sets)), size) * BUCKETS + bucket.astype(np.int64), mix(flat ^ U64(0x5851F42D4C957F2D)))
    smallest = smallest.reshape(len(sets), BUCKETS)
    zeros = 53 - np.frexp((smallest >> U64(11)).astype(np.float64))[1]
    mantissa = (smallest << (zeros + 1).astype(U64)) >> U64(64 - MANTISSA)
    out = ((zeros.astype(U64) << U64(MANTISSA)) | mantissa).astype(np.uint16)
    empty = smallest == _EMPTY
    for d in np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1)):
        have, lack = np.flatnonzero(~empty[d]), np.flatnonzero(empty[d])
        out[d, lack] = out[d, have[_borrow_order()[np.ix_(lack, have)].argmin(axis=1)]]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """``BANDS`` 64-bit keys for each sketch."""
    rows = sketch.astype(U64).reshape(len(sketch), BANDS, ROWS)
    odd = mix(np.arange(1, ROWS + 1, dtype=U64)) | U64(1)
    return mix((rows * odd).sum(axis=2, dtype=U64) + mix(np.arange(BANDS, dtype=U64) + U64(977)))


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates of paired sketches, less the share of registers that agree by chance.

    Two unrelated registers agree if their leading-zero counts do (about 1/3) and then all
    mantissa bits (2**-MANTISSA).
    """
    chance = 2.0**-MANTISSA / 3
    return np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)


def least_estimate(percent: int) -> float:
    """Candidates below this estimate are dropped: the threshold less five standard errors of the registers."""
    p = percent / 100
    return p - 5 * (p * (1 - p) / BUCKETS) ** 0.5


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, fp1, fp2, sketch) of each document; the sketch of an empty set is null."""

    def score(texts: list[bytes | None]) -> dict[str, object]:
        sets = shingle_sets(texts)
        sketch = sketches(sets)
        prints = [[int(mix(s ^ U64(c)).sum(dtype=U64).view(np.int64)) if len(s) else 0 for s in sets] for c in (0x1B873593, 0xE6546B64)]
        return {"n": [len(s) for s in sets], "fp1": prints[0], "fp2": prints[1], "sketch": [k.tobytes() if len(s) else None for k, s in zip(sketch, sets, strict=True)]}

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text"))
    return base.with_columns(rows, "__text", "n bigint, fp1 bigint, fp2 bigint, sketch binary", score).drop("__text")


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``SLICE`` at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, SLICE):
            yield b.slice(lo, SLICE)


def _members(nodes: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, center) of each bucket with two sets or more."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            if b.num_rows:
                k = band_keys(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint16).reshape(-1, BUCKETS))
                each = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(k.reshape(-1).view(np.int64)), b.column(0).take(each), b.column(1).take(each)], names=["key", "id", "n"])

    # A set of n shingles can only link with another one if n / (n + 1) reaches the threshold.
    rows = nodes.where(F.col("n") * 100 >= percent * (F.col("n") + 1)).select("id", "n", "sketch").mapInArrow(keys, "key bigint, id bigint, n bigint").select("key", "id", "n")
    shared = rows.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("other")).where("center <> other").select("key", "center")
    # Written first: while it is small it is broadcast, and a bucket's members stay where they are.
    return base.written(rows.join(base.sized(base.written(shared, "buckets"), SHARE), "key"), "members")


def _sets(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of the documents ``ids``, from their whole texts."""
    ids = base.written(ids.distinct(), "ids")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("__text")).join(base.sized(ids), "id", "left_semi")
    as_list = lambda t: {"shingles": [s.view(np.int64) for s in shingle_sets(t)]}
    return base.written(base.with_columns(texts, "__text", "shingles array<bigint>", as_list).drop("__text"), "sets")


def _across(open_: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Pairs (a, b) of open buckets' members in different components that may still be links.

    Shingles in at most ``RARE`` open sets are rare.  With all shingles ordered by frequency, the
    first common shingle of a link lies in the prefix of both sets, so a link either shares a rare
    prefix shingle (found by a join on it, at most ``RARE`` partners each), or shares no rare
    shingle at all, and then at most the r others.  Members whose r can't reach the threshold with
    the smallest size of their bucket drop out before any pair of the bucket is made, so a dense
    group of loose copies doesn't pair up.
    """
    sets = _sets(open_.select("id"), docs, id_col, text_col)
    each = sets.select("id", F.explode("shingles").alias("g"))
    rare = each.join(each.groupBy("g").agg(F.count("*").alias("df")).where(F.col("df") <= RARE), "g")
    rare = rare.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("rare"))
    nodes = open_.select("id", "n", "component").distinct().join(rare, "id", "left")
    nodes = base.written(nodes.select("id", "n", "component", (F.col("n") - F.coalesce(F.size("rare"), F.lit(0))).alias("r"), "rare"), "nodes")
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    prefix = nodes.where("rare is not null").select("id", "n", "component", F.explode(F.slice("rare", F.lit(1), length)).alias("x")).where("x.df > 1").select(F.col("x.g").alias("key"), "id", "n", F.col("n").alias("r"), "component")
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    by_rare = _paired(prefix, sized)
    shared = open_.select("key", "id").join(base.sized(nodes.select("id", "n", "r", "component"), SHARE), "id")
    least = open_.groupBy("key").agg(F.min("n").alias("least"))
    hopeful = shared.join(least, "key").where(100 * F.col("r") >= percent * (F.col("n") + F.greatest("least", "r") - F.col("r")))
    hopeful = base.written(hopeful.select("key", "id", "n", "r", "component"), "hopeful")
    mixed = hopeful.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    most = F.least("ra", "rb")
    hopeful = base.written(hopeful.join(base.sized(base.written(mixed, "mixed-hopeful"), SHARE), "key", "left_semi"), "paired")
    by_bucket = _paired(hopeful, 100 * most >= percent * (F.col("na") + F.col("nb") - most))
    return base.written(by_rare.union(by_bucket).distinct(), "across")


def _paired(members: DataFrame, fits: Column) -> DataFrame:
    """Pairs (a, b) of members (key, id, n, r, component) of one key in different components."""
    x, y = (members.select("key", *[F.col(c).alias(c[0] + k) for c in ("id", "n", "r", "component")]) for k in "ab")
    return x.join(y, "key").where((F.col("ca") < F.col("cb")) & fits).select(F.col("ia").alias("a"), F.col("ib").alias("b"))


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Those pairs (a, b) of ids that are links: first by estimate, then on full sets."""
    pairs, least = base.written(pairs, "pairs"), least_estimate(percent)
    ends = base.written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")
    # Only these sketches are dealt out; a pair with its sketch is 400 bytes, so few of those are broadcast.
    sketch = base.written(nodes.select("id", "sketch").join(base.sized(ends, SHARE), "id", "left_semi"), "sketches")
    left = base.sized(pairs, SHARE).join(sketch.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a")
    both = base.written(left, "left")
    both = base.sized(both, SHARE).join(sketch.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b").select("a", "b", "sa", "sb")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in sliced(batches):
            if x.num_rows:
                a, b = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (2, 3))
                yield x.select(["a", "b"]).filter(pa.array(estimate(a, b) >= least))

    near = base.written(both.mapInArrow(close, "a bigint, b bigint").distinct(), "near")
    sets = _sets(near.select(F.col("a").alias("id")).union(near.select("b")), docs, id_col, text_col)
    first = base.sized(near, SHARE).join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    second = first.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    linked = second.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")
    return base.written(linked.distinct(), "links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each document."""
    docs = docs.select(id_col, text_col)
    sets = base.written(features(docs, id_col, text_col), "features")
    equal = sets.where("n > 0 and id is not null").groupBy("fp1", "fp2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").drop("last")
    equal = base.sized(base.written(equal, "equal"), SHARE)
    every = sets.join(equal, ["fp1", "fp2"], "left").withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    # Both are written, and so is what follows before its next join: no plan of many rebuilds this broadcast or holds two.
    nodes = base.written(every.where("id = rep and n > 0").select("id", "n", "sketch"), "nodes")
    every = base.written(every.select("id", "n", "rep"), "every")
    members = _members(nodes, percent)
    stars = members.where("id <> center").select(F.col("center").alias("a"), F.col("id").alias("b")).distinct()
    links = _confirmed(stars, nodes, docs, id_col, text_col, percent)
    first = base.written(components(links), "components")
    placed = base.written(members.join(base.sized(first, SHARE), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    open_ = base.written(placed.where("id <> center").join(base.sized(base.written(mixed, "mixed"), SHARE), "key", "left_semi"), "open")
    label = first
    across = _across(open_, docs, id_col, text_col, percent)
    if across.limit(1).count():
        more = _confirmed(across, nodes, docs, id_col, text_col, percent)
        label = base.written(components(links.union(more)), "components")
    out = every.join(base.sized(label.select(F.col("id").alias("rep"), "component"), SHARE), "rep", "left")
    component = F.coalesce("component", "rep")
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id."""
    dropped = base.written(classes(docs, id_col, text_col, percent).where("not kept").select(F.col("id").alias("gone")).distinct(), "dropped")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(f"`{id_col}`").alias("id"))
    return rows.join(base.sized(dropped), F.col("id") == F.col("gone"), "left_anti").select("doc.*")
