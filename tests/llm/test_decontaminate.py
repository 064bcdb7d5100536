"""Decontamination against a brute-force scan, by broadcast and by shuffle."""

import hashlib
import random
import re

import pytest
from slotstream.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items):
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for item, body in items:
            b = words(body)
            n = min(len(b), 10)
            grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


ITEMS = [(1, "The quick, brown fox jumps over the lazy dog and then it rests a while."), (2, "two words"), (10, "TWO-words"), (3, ""), (4, None), (5, "Ünïcode é"), (7, "a a a a a a a a a a a a")]
DOCS = [(0, None), (1, ""), (2, "x the quick brown fox jumps over the lazy dog and then it y"), (3, "two, words! two words"), (4, "Ünïcode é Ünïcode"), (5, "a " * 30), (6, "!!!"), (7, "the quick brown fox jumps over the lazy dog and"), (8, "clean text only " * 2000), (8, "clean text only " * 2000)]


BOUNDS = pytest.mark.parametrize("limit", [decontaminate.BROADCAST_BYTES, -1])


@BOUNDS
def test_matches_brute_force(spark, limit):
    docs = spark.createDataFrame([(d, t, 1.5) for d, t in DOCS], "doc_id bigint, text string, n_words double")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    rows = decontaminate.contamination(docs, items, broadcast_bytes=limit).collect()
    assert len(rows) == len(DOCS)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows} == brute(DOCS, ITEMS)


@BOUNDS
def test_string_ids_and_random_texts(spark, limit):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["a", "b", "É", "c7"]) for _ in range(n))
    items = [(f"q{k}", text(r.choice([1, 3, 4, 10, 11, 25]))) for k in range(25)] + [("q1", text(12)), (None, text(2)), ("q30", None)]
    docs = [(d, text(r.choice([0, 2, 9, 40, 300]))) for d in range(40)]
    rows = decontaminate.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string"), broadcast_bytes=limit)
    assert rows.columns == ["doc_id", "text", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows.collect()}
    assert got == brute(docs, [x for x in items if None not in x])


@BOUNDS
def test_removal_and_empty_tables(spark, limit):
    docs = spark.createDataFrame([(d, t, "y") for d, t in DOCS], "doc_id bigint, text string, contaminated string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    kept = decontaminate.decontaminated(docs, items, broadcast_bytes=limit)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 6, 8, 8]
    cut = decontaminate.decontaminated(docs, items, remove="span", broadcast_bytes=limit)
    assert cut.columns == docs.columns and cut.count() == len(DOCS)
    spans = {r.doc_id: r.text for r in cut.collect()}
    assert spans[2] == "x   y" and spans[0] is None and spans[1] == "" and spans[8] == DOCS[8][1] and spans[3] == " " and spans[5] == "  "
    assert decontaminate.contamination(docs, items.limit(0), broadcast_bytes=limit).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), items, broadcast_bytes=limit).count() == 0


def test_the_set_is_small():
    """A megabyte of benchmark takes a few times its size, not hundreds."""
    r = random.Random(5)
    items = [(k, " ".join(f"w{r.randrange(50_000)}" for _ in range(400)).encode()) for k in range(430)]
    windows = decontaminate.WindowSet(items)
    size = len(windows.body) + sum(x.nbytes for x in (windows.h, windows.begin, windows.width, windows.item, *windows.filters.values()))
    assert size < 6 * sum(len(x) for _, x in items) + (1 << 20)
