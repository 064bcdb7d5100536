"""Chat formatting by quotation linking, with DataFrame functions only.

A message's lines carry quote marks (``>``, nested as ``> >`` or ``>>``); their number is the
line's quote level.  A passage is a run of neighbouring lines of one level; a blank line ends it.

* A passage is normalised (marks off, lower case, white space and line breaks run to one space),
  hashed as a whole, and linked to the latest earlier message of the conversation that says the
  same passage in its own words (level 0), however either was wrapped.
* A quoted passage that is nobody's whole passage is linked line by line in the same way.
* Equal hashes are verified on the text.  The message that most first-level lines link to (the
  later one on a tie) is the parent, and the links form threads.

The result has one row per message: its text without quotes, its parent, the root and depth of its
thread, its ``place`` in the thread's reply order (depth first, so that a message follows what it
answers and all replies to that before it), and what was quoted.  Nothing gathers a conversation,
a common line or a thread into one row or task: the latest earlier saying is found within buckets of
turns and then among bucket ends, and thread, depth and place come from one list ranking over each
thread's round trip (``_ranked``), whose joins meet every element once.

Defined cases: a null text has no lines and stays null; a message that is all quotes becomes
empty; without a link a message starts its own thread at place 0; rows with a null conversation or
turn are linked to nothing; messages that share a conversation and turn are one node and get the
same parent and place, and those with equal text as well count once; an empty table gives an empty
result; extra columns pass through at the end, those named like a result column give way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotstream.llm import base

_MARKS = r"^((?:[ \t]*+>)++)[ \t]?"
RESULT = ["conv_id", "turn", "role", "text", "parent_turn", "thread", "depth", "place", "n_quoted", "n_linked", "max_level"]


def quote_level(line: Column) -> Column:
    """Number of quote marks before the words of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), "[^>]", ""))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, _MARKS, "")), r"[ \t\r]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, level, lines) of each passage: its first line's place, and its normalised lines."""
    lines = F.split("text", "\n")
    read = messages.select("conv_id", "turn", F.transform(lines, quote_level).alias("levels"), F.transform(lines, normalised).alias("plains"))
    begins = lambda i: (F.get("plains", i) != "") & ((i == 0) | (F.get("plains", i - 1) == "") | (F.get("levels", i - 1) != F.get("levels", i)))
    heads = F.filter(F.sequence(F.lit(0), F.size("plains") - 1), begins)
    read = read.where("plains is not null").select("*", heads.alias("heads"))
    cut = lambda h, k: F.filter(F.slice("plains", h + 1, F.coalesce(F.get("heads", k + 1), F.size("plains")) - h), lambda x: x != "")
    each = F.transform("heads", lambda h, k: F.struct(h.alias("pos"), F.get("levels", h).alias("level"), cut(h, k).alias("lines")))
    return read.select("conv_id", "turn", F.inline(each))


def _latest(asked: DataFrame, said: DataFrame) -> DataFrame:
    """(conv_id, hash, plain, turn, source) of the rows (conv_id, hash, plain, turn) of ``asked``: the latest earlier turn in ``said``.

    Turns are dealt into about as many buckets as a bucket has turns: first the latest saying in the
    own bucket counts, then the last one of an earlier bucket, so that a line said or quoted in every
    turn is spread over tasks.
    """
    lo, hi = asked.agg(F.min("turn"), F.max("turn")).first()
    width = max(1, math.isqrt(max(0, (hi or 0) - (lo or 0))) + 1)
    key = ["conv_id", "hash", "plain"]
    bucket = F.floor(F.col("turn") / width).alias("bucket")
    asked, said = asked.distinct().select("*", bucket), said.distinct().select("*", bucket)
    both = asked.withColumn("said", F.lit(None).cast("bigint")).unionByName(said.withColumn("said", F.col("turn")))
    before = lambda keys, by: Window.partitionBy(*keys).orderBy(by).rangeBetween(Window.unboundedPreceding, -1)
    here = both.withColumn("near", F.max("said").over(before([*key, "bucket"], "turn"))).where("said is null").drop("said")
    ends = both.groupBy(*key, "bucket").agg(F.max("said").alias("last")).withColumn("far", F.max("last").over(before(key, "bucket")))
    return here.join(ends.where("far is not null").drop("last"), [*key, "bucket"], "left").select(*key, "turn", F.coalesce("near", "far").alias("source"))


def links(messages: DataFrame) -> DataFrame | None:
    """(conv_id, turn, level, source, lines): how many quoted lines of each level link to which earlier turn; None without quotes."""
    key = ["conv_id", "hash", "plain"]
    units = passages(messages.where("conv_id is not null and turn is not null"))
    quotes = units.where("level > 0").distinct()
    quotes = base.written(quotes.select("conv_id", "turn", "pos", "level", "lines", F.array_join("lines", " ").alias("plain")).withColumn("hash", F.xxhash64("plain")), "quotes")
    if not quotes.limit(1).count():
        return None
    own = units.where("level = 0").select("conv_id", "turn", "lines")

    def met(rows: DataFrame, said: DataFrame) -> DataFrame:
        said = said.withColumn("hash", F.xxhash64("plain")).join(rows.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi")
        source = _latest(rows.select(*key, "turn"), said.select(*key, "turn"))
        return base.written(rows.join(source, [*key, "turn"]), "met")

    whole = met(quotes, own.select("conv_id", "turn", F.array_join("lines", " ").alias("plain")))
    rest = whole.where("source is null").select("conv_id", "turn", "level", F.explode("lines").alias("plain")).withColumn("hash", F.xxhash64("plain"))
    rest = base.written(rest, "rest")
    single = met(rest, own.select("conv_id", "turn", F.explode("lines").alias("plain")))
    found = whole.select("conv_id", "turn", "level", "source", F.size("lines").cast("bigint").alias("lines")).union(single.select("conv_id", "turn", "level", "source", F.lit(1).cast("bigint")))
    return found.where("source is not null").groupBy("conv_id", "turn", "level", "source").agg(F.sum("lines").alias("lines"))


def _next_sibling(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, sibling): the next turn with the same parent, found as in ``_latest`` but forward."""
    lo, hi = parents.agg(F.min("turn"), F.max("turn")).first()
    width = max(1, math.isqrt(max(0, (hi or 0) - (lo or 0))) + 1)
    family = ["conv_id", "parent_turn"]
    rows = parents.select("*", F.floor(F.col("turn") / width).alias("bucket"))
    rows = rows.withColumn("near", F.lead("turn").over(Window.partitionBy(*family, "bucket").orderBy("turn")))
    heads = rows.groupBy(*family, "bucket").agg(F.min("turn").alias("head")).withColumn("far", F.lead("head").over(Window.partitionBy(*family).orderBy("bucket")))
    return rows.join(heads, [*family, "bucket"]).select("conv_id", "turn", F.coalesce("near", "far").alias("sibling"))


def _ranked(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth, place) of all nodes of the forest (conv_id, turn, parent_turn).

    Each node has two elements, the way down to it and the way up from it; together they are one
    list per thread.  Doubling the step along the list sums up what follows each element.  No two
    elements have the same successor, so no join has a hot key.
    """
    nodes = parents.select("conv_id", "turn").union(parents.select("conv_id", F.col("parent_turn").alias("turn"))).distinct()
    child = parents.groupBy("conv_id", F.col("parent_turn").alias("turn")).agg(F.min("turn").alias("child"))
    tree = nodes.join(child, ["conv_id", "turn"], "left").join(parents, ["conv_id", "turn"], "left").join(_next_sibling(parents), ["conv_id", "turn"], "left")
    down = tree.select("conv_id", "turn", F.lit(False).alias("up"), F.coalesce("child", "turn").alias("next"), F.col("child").isNull().alias("next_up"), F.lit(1).cast("bigint").alias("nodes"), F.lit(1).cast("bigint").alias("balance"))
    up = tree.select("conv_id", "turn", F.lit(True), F.coalesce("sibling", "parent_turn"), F.col("sibling").isNull(), F.lit(0).cast("bigint"), F.lit(-1).cast("bigint"))
    now = down.union(up).withColumn("root", F.when(F.col("next").isNull(), F.col("turn")))
    now = base.written(now, "tour")
    while now.where("next is not null").limit(1).count():
        ahead = now.select("conv_id", F.col("turn").alias("next"), F.col("up").alias("next_up"), F.col("next").alias("n2"), F.col("next_up").alias("u2"), F.col("nodes").alias("more"), F.col("balance").alias("tilt"), F.col("root").alias("end"))
        step = now.join(ahead, ["conv_id", "next", "next_up"], "left")
        total = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
        now = base.written(step.select("conv_id", "turn", "up", F.col("n2").alias("next"), F.coalesce("u2", F.lit(False)).alias("next_up"), total("nodes", "more"), total("balance", "tilt"), F.coalesce("root", "end").alias("root")), "tour")
    all_ = now.where("not up")
    size = all_.where("turn = root").select("conv_id", "root", F.col("nodes").alias("size"))
    return all_.join(size, ["conv_id", "root"]).select("conv_id", "turn", F.col("root").alias("thread"), (-F.col("balance")).alias("depth"), (F.col("size") - F.col("nodes")).alias("place"))


def threads(linked: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, thread, depth, place, n_linked) of the messages that a link starts or ends at."""
    best = linked.where("level = 1").groupBy("conv_id", "turn").agg(F.max(F.struct("lines", "source")).alias("best"))
    parents = base.written(best.select("conv_id", "turn", F.col("best.source").alias("parent_turn")), "parents")
    counts = linked.groupBy("conv_id", "turn").agg(F.sum("lines").alias("n_linked"))
    out = _ranked(parents).join(parents, ["conv_id", "turn"], "left").join(counts, ["conv_id", "turn"], "full")
    return base.written(out, "threads")


def formatted(messages: DataFrame) -> DataFrame:
    """``messages`` (conv_id, turn, role, text, ...) with parent_turn, thread, depth, place, n_quoted, n_linked, max_level; quotes cut."""
    extra = base.without(messages, RESULT)
    doc = F.struct(F.lit(0).alias("no"), *[F.col(f"`{n}`") for n in extra]).alias("doc")
    messages = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", doc)
    linked = links(messages)
    lines = F.split("text", "\n")
    levels = F.transform(lines, quote_level)
    own = F.array_join(F.filter(lines, lambda x: quote_level(x) == 0), "\n")
    if linked is None:
        none = lambda n: F.lit(None).cast("bigint").alias(n)
        out = messages.select("*", *[none(n) for n in ("parent_turn", "thread", "depth", "place", "n_linked")])
    else:
        out = messages.join(base.sized(threads(base.written(linked, "links"))), ["conv_id", "turn"], "left")
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("bigint").alias(n)
    return out.select(
        "conv_id",
        "turn",
        "role",
        F.trim(own).alias("text"),
        "parent_turn",
        F.coalesce("thread", "turn").alias("thread"),
        zero(F.col("depth"), "depth"),
        zero(F.col("place"), "place"),
        zero(F.size(F.filter(levels, lambda n: n > 0)), "n_quoted"),
        zero(F.col("n_linked"), "n_linked"),
        zero(F.array_max(levels), "max_level"),
        *[F.col(f"doc.`{n}`") for n in extra],
    )
