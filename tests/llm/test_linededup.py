"""Line dedup against a brute-force scan of all line pairs."""

import random
import re

from slotstream.llm import linededup


def words(line):
    return [w for w in re.split("[\x20\x09-\x0d]+", line.lower()) if w]


def near(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    places = [(d, t, i, words(x)) for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) if t is not None for i, x in enumerate(t.split("\n"))]
    gone = {(d, t, i) for k, (d, t, i, w) in enumerate(places) if w and any(p[3] and near(p[3], w) for p in places[:k])}
    return {d: (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, t, i) not in gone)) for d, t in rows}


def corpus():
    r = random.Random(4)
    base = [[r.choice("alpha beta gamma delta rho tau phi chi psi eta".split()) for _ in range(n)] for n in (3, 7, 8, 8, 9, 12, 20, 60)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "Alpha  BETA\talpha\n"), (None, "one line of a document without an id at all")]
    for d in range(10, 60):
        lines = []
        for _ in range(r.randint(1, 6)):
            w = list(r.choice(base))
            for _ in range(r.randint(0, 2)):
                k, i = r.randrange(3), r.randrange(len(w))
                w[i : i + (k < 2)] = [] if k == 0 else [f"x{r.randrange(4)}"]
            lines.append("  ".join(w).title() if r.random() < 0.2 else " ".join(w))
        rows.append((d, "\n".join(lines)))
    return rows + [(70, "long " + " ".join(str(i) for i in range(3000))), (71, "long " + " ".join(str(i) for i in range(3000) if i != 1234))]


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, pos string")
    got = linededup.deduplicated(docs)
    assert got.columns == docs.columns
    assert {r.doc_id: r.text for r in got.collect()} == brute(rows)


def test_hot_lines_and_empty_table(spark):
    rows = [(d, f"item {d} of the very long list of things here") for d in range(300)] + [(d, "item 5 of the very long list of things here") for d in range(300, 500)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), counts=True).collect()}
    assert got[0] == (rows[0][1], 1, 0) and all(got[d] == ("", 1, 1) for d in range(1, 500))
    assert linededup.deduplicated(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "same line\n\nother", "a", 7, 1), (1, "same line\n\nother", "b", 8, 2), (1, "same line\n\nother", "b", 8, 2), (2, "Other\nnew", "c", 9, 3), (None, None, None, None, None), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, part string, n_lines int, lines int")
    plain = linededup.deduplicated(docs).collect()
    assert len(plain) == 6 and [r.text for r in plain].count(None) == 2
    one = sorted(r.text for r in plain if r.doc_id == 1)
    assert one == ["", "", "same line\n\nother"] and [r.text for r in plain if r.doc_id == 2] == ["new"]
    assert sorted((r.part, r.n_lines, r.lines) for r in plain if r.doc_id == 1) == [("a", 7, 1), ("b", 8, 2), ("b", 8, 2)]
    counted = linededup.deduplicated(docs, counts=True)
    assert counted.columns == ["doc_id", "text", "part", "lines", "n_lines", "n_removed"]
    assert sorted((r.n_lines, r.n_removed) for r in counted.collect() if r.doc_id == 1) == [(3, 0), (3, 2), (3, 2)]
