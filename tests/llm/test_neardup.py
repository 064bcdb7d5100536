"""Near-duplicate classes against all pairs, and the parts of the sketch."""

import random
import re

import numpy as np
import pytest
from slotstream.llm import graph, neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    n = min(len(w), 5)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows, percent=85):
    sets = {d: shingles(t) for d, t in rows}
    part = {d: d for d in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if either and 100 * both >= percent * either:
                x, y = sorted((root(a), root(b)))
                part[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, texts = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "One  TWO"), (5, "one two three")], []
    for _ in range(25):
        texts.append([r.choice(vocabulary) for _ in range(r.choice([7, 8, 12, 40, 150, 400]))])
    texts.append(["long"] * 3 + [r.choice(vocabulary) for _ in range(6000)])
    for base in texts:
        for k in range(r.randint(1, 6)):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 60))):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((100 + len(rows), " ".join(w) if k else " ".join(base)))
    common = [r.choice(vocabulary) for _ in range(60)]
    for k in range(40):  # a dense group: links by way of others
        w = list(common)
        for j in range(r.randint(0, 1)):
            w[r.randrange(60)] = f"x{k}{j}"
        rows.append((1000 + k, " ".join(w)))
    return rows


@pytest.mark.parametrize("percent", [85, 80])
def test_classes_match_all_pairs(spark, percent):
    rows = [*corpus(), (2000, "p q r s t u v w"), (2001, "p q r s t u v w x")]  # 4 of 5 shingles
    docs = spark.createDataFrame([(d, t, 0, "g") for d, t in rows], "doc_id bigint, text string, n int, gone string")
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in neardup.classes(docs, percent=percent).collect()}
    assert got == brute(rows, percent) and got[2001][2] == (percent == 85)
    left = neardup.deduplicated(docs, percent=percent)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, x in got.items() if x[2])


@pytest.mark.parametrize("limit", [32 << 20, -1])
def test_no_plan_holds_two_broadcasts(spark, monkeypatch, limit):
    plans, real = [], neardup.base.written

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast")))
        return real(df, name)

    monkeypatch.setattr(neardup.base, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(neardup.base, "written", seen)
    rows = corpus()
    out = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in seen(out, "out").collect()} == brute(rows)
    assert {name: n for name, n in plans if n > (limit > 0)} == {}
    assert (limit > 0) == any(n for _, n in plans)


def test_tables_take_a_share_of_the_broadcast_bound(spark, monkeypatch):
    ids = spark.range(100)  # 40 bytes a row
    monkeypatch.setattr(neardup.base, "BROADCAST_BYTES", 8000)
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString()
    assert hinted(neardup.base.sized(ids)) and hinted(neardup.base.sized(ids, 2)) and not hinted(neardup.base.sized(ids, 4))


def test_null_ids_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, "A b c d e f")], "doc_id bigint, text string")
    got = sorted((r.id is None, r.id or 0, r.component_id or 0, r.kept) for r in neardup.classes(docs).collect())
    assert got == [(False, 7, 7, True), (False, 7, 7, True), (False, 9, 7, False), (True, 0, 0, True)]
    assert neardup.classes(docs.limit(0)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_estimate_is_close():
    r = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        error = []
        for _ in range(60):
            a = r.integers(0, 2**63, 500).astype(np.uint64)
            n = int(500 * 2 * share / (1 + share))
            b = np.concatenate((a[:n], r.integers(0, 2**63, 500 - n).astype(np.uint64)))
            s = neardup.sketches([np.unique(a), np.unique(b)])
            error.append(neardup.estimate(s[:1], s[1:])[0] - n / (1000 - n))
        assert abs(np.mean(error)) < 0.015 and np.max(np.abs(error)) < 0.15
