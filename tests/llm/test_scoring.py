"""Language, quality, line labels and toxicity: plain-Python counts, held-out accuracy, edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from slotstream.llm import base, langid, neardup, quality, rules, toxicity
from slotstream.llm.vector import byte_values

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STEMS = {"aa": "ka lo mi nu ra".split(), "bb": "sch tz ung keit ge".split(), "cc": "eau oi tion ment que".split()}
EDGE = [(900_000, None), (900_001, ""), (900_002, " \n\t "), (900_003, "123 !!! ---"), (900_004, "word " * 4000), (900_005, "ü")]


def prose(r, lang, n):
    return " ".join("".join(r.choice(STEMS[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Rows (doc_id, text, lang, quality, toxic)."""
    r, rows = random.Random(6), []
    for d in range(600):
        lang = r.choice(sorted(STEMS))
        lines = [prose(r, lang, r.randint(5, 20)) + "." for _ in range(r.randint(2, 8))]
        good, toxic = r.random() > 0.25, r.random() < 0.2
        if not good:
            lines = [" | ".join(x.upper().split()) + " $$$" for x in lines]
        if toxic:
            w = lines[0].split()
            for bad in r.choices(["moronic", "scumbag"], k=r.randint(1, 3)):
                w.insert(r.randrange(len(w)), bad)
            lines[0] = " ".join(w)
        rows.append((d, "\n".join(lines), lang, int(good), int(toxic)))
    return rows


def frames(spark, corpus):
    docs = spark.createDataFrame([r[:3] + ("x",) for r in corpus] + [(d, t, None, "x") for d, t in EDGE], "doc_id bigint, text string, lang string, score string")
    return docs, spark.createDataFrame([(r[0], r[3], r[4]) for r in corpus] + [corpus[0][:1] + corpus[0][3:]], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def models(spark, corpus):
    """Each model once, learned outside its held-out fold; ``all_toxic`` from all labels."""
    docs, labels = frames(spark, corpus)
    quality_labels = labels.where(base.fold("doc_id", 5) != 0)
    return {
        "lang": langid.fit(docs.where(base.fold("doc_id", 3) != 1)),
        "quality": quality.fit(docs, quality_labels),
        "field": rules.fit(docs, quality_labels),
        "all_toxic": toxicity.fit(docs, labels),
    }


def held(docs, parts, part):
    return {r.doc_id for r in docs.where(base.fold("doc_id", parts) == part).select("doc_id").collect()}


def test_language(spark, corpus, models):
    docs, _ = frames(spark, corpus)
    model = models["lang"]
    got = {r.doc_id: r for r in langid.predicted(docs, model).collect()}
    assert len(got) == len(corpus) + len(EDGE) and all(0 <= r.score <= 1 for r in got.values())
    test = [r for r in corpus if r[0] in held(docs, 3, 1)]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in test]) > 0.97
    assert {d: got[d].lang_pred == "und" for d, _ in EDGE} == {900_000: True, 900_001: True, 900_002: True, 900_003: True, 900_004: False, 900_005: False}
    empty = langid.fit(docs.where("lang = 'zz'"))
    assert {r.lang_pred for r in langid.predicted(docs, empty).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'aa'"))
    assert {r.lang_pred for r in langid.predicted(docs, one).collect()} == {"und", "aa"}


def test_codewords_differ():
    for n in (2, 3, 4, 7, 20, 60):
        code = langid.codewords(n)
        assert len({tuple(c) for c in code.tolist()}) == n
        assert n == 2 or min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= 3


def test_quality(spark, corpus, models):
    docs, labels = frames(spark, corpus)
    model = models["quality"]
    got = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    test = [r for r in corpus if r[0] in held(docs, 5, 0)]
    assert np.mean([got[r[0]].predicted == r[3] for r in test]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    none = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}


def test_toxicity(spark, corpus):
    docs, labels = frames(spark, corpus)
    model = toxicity.fit(docs, labels.where(base.fold("doc_id", 3) != 1))
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    test = [r for r in corpus if r[0] in held(docs, 3, 1)]
    assert np.mean([got[r[0]].predicted == r[4] for r in test]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values()) and got[900_000].predicted == got[900_001].predicted == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.scored(docs, none).collect()} == {0.0}
    shown = {r.doc_id: r.passages for r in toxicity.toxic_passages(docs, model).collect()}
    assert any("moronic" in p for d, t, *_ in corpus if "moronic" in t for p in shown[d])


def brute_segments(scores):
    """Maximal-scoring segments by definition: split at the best segment, again and again."""
    if not any(s > 0 for s in scores):
        return []
    best, at = 0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, at = total, (i, j)
    i, j = at
    left = brute_segments(scores[:i])
    right = [(s, a + j + 1, b + j + 1) for s, a, b in brute_segments(scores[j + 1 :])]
    return left + [(best, i, j)] + right


def test_segments_match_the_definition():
    r = random.Random(8)
    for _ in range(300):
        scores = [r.choice([-0.15, -0.15, -0.15, round(r.uniform(0.05, 1.0), 3) + 0.00037]) for _ in range(r.randint(0, 25))]
        at = np.array([i for i, s in enumerate(scores) if s > 0], int)
        got = toxicity.segments(at, np.array([scores[i] for i in at]))
        want = brute_segments(scores)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want], scores
        assert np.allclose([s for s, _, _ in got], [s for s, _, _ in want])


def counts(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen = {x: windows.count(x) for x in set(windows)}
    hit = {k for i, x in enumerate(windows) if seen[x] > 1 for k in range(i, i + 8)}
    earlier, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in earlier
            earlier.add(line)
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), failed


def test_line_rules(spark, corpus, models):
    docs, labels = frames(spark, corpus)
    field = models["field"]
    r = random.Random(9)
    extra = [(800_000 + k, "\n".join(" ".join(r.choice("a b c ü".split()) for _ in range(r.randint(0, 12))) + r.choice(["", " ", "\t#"]) for _ in range(r.randint(0, 9)))) for k in range(80)]
    more = spark.createDataFrame(extra, "doc_id bigint, text string")
    rows = rules.judged(docs.select("doc_id", "text").union(more), field).collect()
    want = {r[0]: counts(r[1]) for r in corpus} | {d: counts(t) for d, t in EDGE + extra}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows} == want
    got = {r.doc_id: r for r in rows}
    assert not any(r.kept and r.base_failed for r in rows)
    test = [x for x in corpus if x[0] in held(docs, 5, 0) and not got[x[0]].base_failed]
    assert np.mean([got[x[0]].kept == bool(x[3]) for x in test]) > 0.95


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(3)
    field = rules.Field()
    field.emit, field.step = r.normal(size=field.emit.shape), r.normal(size=(2, 2))
    size = [1, 4, 0, 6]
    bins = r.integers(0, rules.FEATURES, (sum(size), len(rules.BINS))).astype(np.uint8)
    first = np.concatenate(([0], np.cumsum(size)))
    got = field.viterbi(bins, first)
    energy = field.energies(bins)
    for a, b in zip(first[:-1], first[1:], strict=True):
        best = max((sum(energy[a + t, y[t]] for t in range(b - a)) + sum(field.step[y[t - 1], y[t]] for t in range(1, b - a)), y) for y in np.ndindex(*(2,) * int(b - a))) if b > a else (0, ())
        assert tuple(got[a:b]) == tuple(best[1])

M64 = (1 << 64) - 1


def mix64(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M64
    return x ^ (x >> 33)


def gram(raw, lower):
    """The hash of a byte n-gram before mixing."""
    values = byte_values(lower)
    return sum(int(values[b]) * (2 * k + 1) for k, b in enumerate(raw)) & M64


BRUTE_TEXTS = ["", "A", "ab ab\nab", "Straße und ÜBER allem, ka lo mi nu ra " * 3, "x" * 200, "sch\ttz ung  keit ge " * 40]


def test_language_scores_by_definition(models):
    model = models["lang"]
    got = model.predict([t.encode() for t in BRUTE_TEXTS])
    for t, lang, score in zip(BRUTE_TEXTS, got["lang_pred"], got["score"], strict=True):
        x, raw, n = np.zeros(1 << langid.BITS), t.encode(), 0
        for size in langid.ORDERS:
            for i in range(len(raw) - size + 1):
                x[mix64((gram(raw[i : i + size], True) + size - 1) & M64) >> (64 - langid.BITS)] += 1
                n += 1
        x = np.sqrt(x / max(1, n))
        margin = x @ model.w + model.b
        loss = [sum(model.trust[j] * np.log1p(np.exp(-margin[j] * c[j])) for j in range(len(margin))) for c in model.code]
        if not any(map(str.isalpha, t)):
            assert (lang, score) == ("und", 0.0)
            continue
        assert lang == model.langs[int(np.argmin(loss))]
        assert abs(score - 1 / sum(np.exp(-(v - min(loss)) * len(margin)) for v in loss)) < 1e-3


def test_quality_scores_by_definition(models):
    model = models["quality"]
    got = model.score([t.encode() for t in BRUTE_TEXTS])["score"]
    words = quality.Words(quality.Packed([t.encode() for t in BRUTE_TEXTS], b"\n"), ~quality.SPACES)
    hashes = words.hashes(lower=False)
    bucket = lambda h, kind: mix64((h + kind * 0x9E3779B9) & M64) >> (64 - quality.BITS)
    for d, t in enumerate(BRUTE_TEXTS):
        h, raw, total = [int(x) for x in hashes[words.first[d] : words.first[d + 1]]], t.encode(), 0.0
        assert len(h) == len(WORD.findall(t))
        kinds = [[bucket(x, 1) for x in h], [bucket(12345 if a == b else (a * 3 + b) & M64, 2) for a, b in zip(h, h[1:], strict=False)]]
        kinds += [[bucket(gram(raw[i : i + n], False), 2 + n) for i in range(len(raw) - n + 1)] for n in quality.ORDERS]
        for each in kinds:
            total += sum(float(model.part[b]) for b in each) / max(1, len(each))
        assert abs(got[d] - 1 / (1 + np.exp(-(total / quality.KINDS + model.bias)))) < 1e-4


def test_toxicity_by_definition(corpus, models):
    """Document frequencies, weights and scores in plain Python, over the documents that are no copies."""
    model = models["all_toxic"]
    places = {}  # the smallest id of each minimum of each class
    for d, text, _, _, toxic in corpus:
        shingles = [int(x) for x in neardup.shingle_sets([text.encode()])[0]]
        for k in range(toxicity.COPY_KEYS):
            key = (toxic, k, min(mix64(x ^ (0x9E3779B97F4A7C15 * (k + 1) & M64)) for x in shingles))
            places[key] = min(d, places.get(key, d))
    firsts = [r for r in corpus if len({k[1] for k, d in places.items() if d == r[0]}) == toxicity.COPY_KEYS]
    n1, n0 = sum(r[4] for r in firsts), sum(1 - r[4] for r in firsts)
    assert model.n == (n1, n0) and 500 < len(firsts) <= len(corpus)
    seen = {}
    for _, text, _, _, toxic in firsts:
        found = set()
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode()):
            found |= {w} | {(w[:n], n) for n in toxicity.PREFIXES if len(w) > n}
        for f in found:
            seen.setdefault(f, [0, 0])[toxic] += 1

    def weight(y, x):
        n, share = n1 + n0, (x + y) / (n1 + n0)
        c, most = 1 + toxicity.PRIOR * share, 1 + (1 + toxicity.PRIOR) / (n1 + n0)
        a, b = x + c * n1 / n, y + c * n0 / n
        odds = np.log(a / (n1 * most - a)) - np.log(b / (n0 * most - b)) - np.sqrt(1 / a + 1 / b)
        g = 2 * sum(v * np.log(v / ((x + y) * k / n)) for v, k in ((x, n1), (y, n0)) if v)
        return odds if x * n0 > y * n1 and g >= toxicity.LEAST_Z**2 and odds >= toxicity.LEAST_WEIGHT else 0.0

    weights = {f: weight(*v) for f, v in seen.items()}
    assert sum(w > 0 for w in weights.values()) == len(model.h)
    texts = [r[1] for r in corpus[:60]] + [t for _, t in EDGE]
    got = model.score([t.encode() if t is not None else None for t in texts])["score"]
    for t, score in zip(texts, got, strict=True):
        words = re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").lower().encode())
        each = []
        for w in words:
            long_first = [weights.get(w, 0.0)] + [weights.get((w[:n], n), 0.0) for n in reversed(toxicity.PREFIXES) if len(w) > n]
            each.append(next((x for x in long_first if x > 0), toxicity.NEUTRAL))
        chance = np.log(model.scale * max(1, len(words)))
        spots = [i for i, s in enumerate(each) if s > 0]
        found = brute_segments(each) if len(each) < 400 else [(each[i], i, i) for i in spots]
        x = sum(max(0.0, model.rate * s - chance) for s, _, _ in found)
        assert abs(score - 1 / (1 + np.exp(-(model.curve[0] * np.log1p(x) + model.curve[1])))) < 1e-3, t


def test_toxicity_short_passages_and_copies(spark):
    """One toxic passage is found in texts of 50 to 5,000 words; a much copied toxic text makes no ordinary word a feature."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice(STEMS["aa"]) for _ in range(3)) for _ in range(60)]
    plain = lambda n: [r.choice(vocabulary) for _ in range(n)]
    rows, d = [], 0
    for _ in range(500):
        words = plain(r.choice([20, 60, 200]))
        toxic = r.random() < 0.2
        if toxic:
            at = r.randrange(len(words))
            words[at:at] = r.sample(["scumbag", "moronic", "vermin"], 2)
        rows.append((d, " ".join(words), int(toxic)))
        d += 1
    copied = ["peculiar", "ordinary", "topical", *plain(60)]
    for _ in range(150):  # near copies, all toxic by one word
        words = list(copied)
        words[r.randrange(5, 60)] = r.choice(vocabulary)
        rows.append((d, " ".join([*words, "vermin"]), 1))
        d += 1
    for _ in range(60):  # the same topic without it
        rows.append((d, " ".join(["peculiar", *plain(40)]), 0))
        d += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert model.n[0] < 130 and model.n[1] > 400
    tests = []
    for n in (50, 200, 1000, 5000):
        words = plain(n)
        tests += [(" ".join(words), 0), (" ".join(["ordinary", "topical", "peculiar", *words]), 0)]
        words[n // 2 : n // 2] = ["you", "moronic", "scumbag"]
        tests.append((" ".join(words), 1))
    got = model.score([t.encode() for t, _ in tests])["predicted"]
    assert list(got) == [y for _, y in tests]


def test_empty_tables_and_repeated_rows(spark, corpus, models):
    """Scoring an empty table gives an empty result; rows that share an id get a row each; a null id is scored."""
    docs, labels = frames(spark, corpus)
    some = docs.where("doc_id < 3").union(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("bigint")))
    for scored in (
        lambda x: langid.predicted(x, models["lang"]),
        lambda x: quality.scored(x, models["quality"]),
        lambda x: rules.judged(x, models["field"]),
        lambda x: toxicity.scored(x, models["all_toxic"]),
    ):
        empty = scored(docs.limit(0))
        assert empty.count() == 0 and "doc_id" in empty.columns and empty.columns.count("score") <= 1
        rows = scored(some.select("doc_id", "text")).collect()
        assert len(rows) == 7 and len({tuple(r) for r in rows}) == 4
    none = docs.limit(0)
    assert {r.score for r in toxicity.scored(some, toxicity.fit(none, labels)).collect()} == {0.0}
    assert {r.score for r in quality.scored(some, quality.fit(none, labels)).collect()} == {0.5}
