"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared as words after lower-casing and trimming white space.  A line goes if an
earlier line of the corpus (by document id, then place) equals it or, where both have
``least_words`` words or more, lies within an edit distance of one word: one word put in, left out
or replaced.  Lines without a word stay.

* Equal lines share a 128-bit hash; a class of equal lines has one first place.
* One edit leaves the front or the back half of a line alone, so only lines that share a half with
  another line can have a neighbour; the others make no variants (blocked deletion neighbourhood).
* Each remaining line emits, as hashed keys, itself and every variant with one word deleted.  Equal
  keys are joined by way of their earliest line, never pairwise: lines that lose the same place
  (a replaced word) all match each other, and a line matches those that become it by one deletion.
* Matches are verified word for word before anything is removed.

Defined cases: a null text stays null, an empty text stays empty; a text that loses all lines
becomes empty, its document stays; rows that share a document id count as one after the other by
their text's hash; of rows that share id and text one stays as it would alone, the others lose every
line with a word (they repeat it); a null id comes first; input columns of any other name pass
through, and those named like a count column give way where counts are asked for.  Ids are whole
numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slotstream.llm import base

LEAST_WORDS = 8


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[\x20\x09-\x0D]+"), "")


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, pos, n, h1, h2, and four half keys) of each line with a word; part tells texts that share an id apart."""
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    lines = texts.select("id", F.xxhash64("text").alias("part"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    worded = lines.select("id", "part", "pos", _words(F.col("line")).alias("w")).where(F.size("w") > 0)
    n = F.size("w")

    def half(size: Column, front: bool) -> Column:
        """Key of the front (back) half of a line, for pairs whose shorter line has ``size`` words."""
        k = F.floor(size / 2).cast("int")
        part = F.slice("w", 1, k) if front else F.slice("w", n - (size - k) + 1, size - k)
        return F.xxhash64(F.lit(front), size, part)

    halves = F.when(n >= LEAST_WORDS, F.array(*[half(n - d, front) for d in (0, 1) for front in (True, False)]))
    return worded.select("id", "part", "pos", n.alias("n"), F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"), halves.alias("halves"))


def _edit(a: str, b: str) -> Column:
    """True if word arrays ``a`` and ``b`` are within one word's edit: equal but for one place, or one deletion."""
    x, y = F.col(a), F.col(b)
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    k = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)), F.least(F.size(x), F.size(y)) + 1).cast("int")
    rest = lambda v, at: F.slice(v, at, F.greatest(F.lit(0), F.size(v) - at + 1))
    replaced = (F.size(x) == F.size(y)) & (rest(x, k + 1) == rest(y, k + 1))
    return replaced | (rest(x, k + 1) == rest(y, k)) | (rest(x, k) == rest(y, k + 1))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, pos) of each line that goes."""
    place = F.struct("id", "part", "pos")
    lines = base.written(numbered_lines(docs, id_col, text_col), "lines")
    distinct = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    distinct = base.written(distinct, "distinct")
    near = base.written(_near(distinct, docs, id_col, text_col), "near")
    # Of a class of equal lines all but the first go; of a class with an earlier neighbour all go.
    repeated = distinct.where("first <> last").select("h1", "h2", "first").join(base.sized(near), ["h1", "h2"], "left_anti")
    gone = base.written(repeated.union(near.select("h1", "h2", F.lit(None).cast(near.schema["first"].dataType).alias("first"))), "gone")
    return lines.select("h1", "h2", "id", "part", "pos").join(base.sized(gone), ["h1", "h2"]).where(F.col("first").isNull() | (place != F.col("first"))).select("id", "part", "pos")


def _near(distinct: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, first) of the distinct lines that have an earlier line within one word's edit."""
    keys = distinct.where("halves is not null").select(F.explode("halves").alias("half"), "h1", "h2")
    shared = keys.groupBy("half").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("half")
    shared = base.sized(base.written(shared, "halves"))
    some = base.written(keys.join(shared, "half", "left_semi").select("h1", "h2").distinct(), "candidates")
    firsts = base.written(distinct.join(base.sized(some), ["h1", "h2"], "left_semi").select("h1", "h2", "first.*", "n"), "firsts")
    # Their words: only candidates' first lines are cut out of the texts again.
    cut = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("__id"), F.col(f"`{text_col}`").alias("text")).where("text is not null")
    lines = cut.select("__id", F.xxhash64("text").alias("__part"), F.posexplode(F.split("text", "\n")).alias("__pos", "line"))
    met = (F.col("__id").eqNullSafe(F.col("id"))) & (F.col("__part") == F.col("part")) & (F.col("__pos") == F.col("pos"))
    texts = lines.join(base.sized(firsts), met).select("h1", "h2", F.struct("id", "part", "pos").alias("first"), "n", _words(F.col("line")).alias("w"))
    texts = base.written(texts.dropDuplicates(["h1", "h2"]), "texts")
    each = texts.select("h1", "h2", "first", "n", F.posexplode("w").alias("i", "word"))
    each = each.select("h1", "h2", "first", "n", "i", F.xxhash64("word", "i").alias("here"), F.xxhash64("word", F.col("i") - 1).alias("back"))
    # Exclusive-or of the words' hashes by place, before and behind each deleted word.
    line = Window.partitionBy("h1", "h2")
    upto = line.orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.select("*", F.expr("bit_xor(here)").over(line).alias("all"), F.expr("bit_xor(back)").over(line).alias("all_back"), F.expr("bit_xor(here)").over(upto).alias("so_far"), F.expr("bit_xor(back)").over(upto).alias("so_far_back"))
    gap = F.col("all").bitwiseXOR(F.col("here"))
    shorter = F.col("so_far").bitwiseXOR(F.col("here")).bitwiseXOR(F.col("all_back")).bitwiseXOR(F.col("so_far_back"))
    forms = F.array(
        F.struct(F.lit("replaced").alias("form"), F.xxhash64("n", "i", gap).alias("key")),
        F.struct(F.lit("deleted").alias("form"), F.xxhash64(F.col("n") - 1, shorter).alias("key")),
        F.when(F.col("i") == 0, F.struct(F.lit("whole").alias("form"), F.xxhash64("n", "all").alias("key"))),
    )
    variants = each.select("h1", "h2", "first", F.explode(F.filter(forms, lambda f: f.isNotNull())).alias("v")).select("v.form", "v.key", "h1", "h2", "first")
    variants = base.written(variants, "variants")
    lead = F.min(F.struct("first", "h1", "h2"))
    met = lambda left, right: variants.where(F.col("form") == left).join(variants.where(F.col("form") == right).groupBy("key").agg(lead.alias("lead")), "key").where(F.col("lead.first") < F.col("first"))
    pairs = met("replaced", "replaced").union(met("deleted", "whole")).union(met("whole", "deleted"))
    pairs = base.written(pairs.select("h1", "h2", F.col("lead.h1").alias("g1"), F.col("lead.h2").alias("g2")).distinct(), "pairs")
    mine = base.sized(pairs).join(texts.select("h1", "h2", "first", F.col("w").alias("x")), ["h1", "h2"])
    both = mine.join(texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("w").alias("y")), ["g1", "g2"])
    return both.where(_edit("x", "y")).select("h1", "h2", "first").distinct()


def _copies(rows: DataFrame) -> DataFrame:
    """``rows`` (doc, id, text, part) with ``copy``: true for all but one of the rows that share id and text.

    Rows are told apart only where there are such rows: these are written with an ordinal of their own.
    """
    repeated = rows.where("text is not null").groupBy("id", "part").count().where("count > 1").select("id", "part")
    repeated = base.written(repeated, "repeated")
    if not repeated.limit(1).count():
        return rows.withColumn("copy", F.lit(False))
    few = base.sized(repeated.select(F.col("id").alias("rid"), F.col("part").alias("rpart")))
    same = F.col("id").eqNullSafe(F.col("rid")) & (F.col("part") == F.col("rpart"))
    some = base.written(rows.join(few, same, "left_semi").withColumn("at", F.monotonically_increasing_id()), "repeated-rows")
    first = base.written(some.groupBy("id", "part").agg(F.min("at").alias("at")).select("at"), "first-rows")
    marked = some.join(base.sized(first.withColumn("first", F.lit(True))), "at", "left").withColumn("copy", F.col("first").isNull())
    return rows.join(few, same, "left_anti").withColumn("copy", F.lit(False)).unionByName(marked.drop("at", "first"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with the lines that go cut out of the text; ``counts`` adds n_lines and n_removed."""
    names = base.without(docs, ["n_lines", "n_removed"]) if counts else docs.columns
    doc = F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc")
    rows = docs.select(doc, F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("part"))
    gone = removed_lines(docs, id_col, text_col).groupBy("id", "part").agg(F.collect_set("pos").alias("gone"))
    gone = base.written(gone.withColumnsRenamed({"id": "gid", "part": "gpart"}), "gone")
    met = F.col("id").eqNullSafe(F.col("gid")) & (F.col("part") == F.col("gpart"))
    out = _copies(rows).join(base.sized(gone), met, "left").withColumn("lines", F.split("text", "\n"))
    worded = lambda x: F.size(_words(x)) > 0
    stays = lambda x, i: F.when(F.col("copy"), ~worded(x)).otherwise(~F.array_contains("gone", i))
    kept = F.when(F.col("copy") | F.col("gone").isNotNull(), F.filter("lines", stays)).otherwise(F.col("lines"))
    out = out.withColumn("kept", kept)
    text = F.when(F.col("copy") | F.col("gone").isNotNull(), F.array_join("kept", "\n")).otherwise(F.col("text"))
    columns = [text.alias(n) if n.lower() == text_col.lower() else F.col(f"doc.`{n}`") for n in names]
    if counts:
        size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
        columns += [size("lines").alias("n_lines"), (size("lines") - size("kept")).alias("n_removed")]
    return out.select(*columns)
