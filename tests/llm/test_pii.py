"""Surrogates: nothing real stays, forms and identities hold, the rest of the text is untouched."""

import hashlib
import hmac
import random
import re

from pyspark.sql import functions as F
from slotstream.llm import pii

ROWS = [
    (1, "mail and.34@mail7.example.com or John.Doe@corp.co.uk, IP 97.51.17.173 and 1.2.3.4. Call +1 (017) 555-7713!"),
    (2, "+1 017 555 7713 is the same; 4111 1111 1111 1111 and 4111111111111111 and 9807915762804490%%%"),
    (3, "token = \"04dbebab91ab85687d33eeaaf9\" password: 'hunter22XY' Frau Anna Weber met Herr Weber and Frau Weber; Госпожа Иванова."),
    (4, None),
    (5, ""),
    (6, "no entities 12 34, mr. x, version 1.2.3.4.5, 12345678901234567"),
    (7, "SSN 123-45-6789 IBAN DE89 3704 0044 0532 0130 00 JOHN.DOE@CORP.CO.UK éa.2@x.fr"),
    (7, "SSN 123-45-6789 IBAN DE89 3704 0044 0532 0130 00 JOHN.DOE@CORP.CO.UK éa.2@x.fr"),
    (8, "+1 (017) 555-7713" + " filler words" * 3000 + " +1 (017) 555-7713"),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_surrogates(spark):
    docs = spark.createDataFrame([(d, t, 1, "r", 2) for d, t in ROWS], "doc_id bigint, text string, n_entities int, raw string, new int")
    frame = pii.replaced(docs, counts=True)
    assert frame.columns == ["doc_id", "text", "raw", "new", "n_entities"]
    rows = frame.collect()
    assert len(rows) == len(ROWS) and all(r.raw == "r" and r.new == 2 for r in rows)
    got = {r.doc_id: r.text for r in rows}
    assert {r.doc_id: r.n_entities for r in rows} == {1: 5, 2: 4, 3: 6, 4: 0, 5: 0, 6: 0, 7: 4, 8: 2}
    assert got[4] is None and got[5] == "" and got[6] == ROWS[5][1]
    for real in ("and.34@mail7", "Doe", "97.51.17.173", "1.2.3.4.", "555-7713", "017", "4111", "9807915762804490", "04dbeb", "hunter22XY", "Anna", "Weber", "Иванова", "123-45", "3704", "éa.2"):
        assert not any(real in (t or "") for d, t in got.items() if d != 6), real
    one = re.fullmatch(r"mail ([a-z]{3}\.\d\d@[a-z]{4}\d\.example\.com) or ([A-Z][a-z]{3}|[a-z]{4})\.([A-Z]?[a-z]{2,3})@[a-z]{4}\.[a-z]{2}\.uk, IP (\d\d\.\d\d\.\d\d\.\d{3}) and (\d\.\d\.\d\.\d)\. Call (\+1 \(\d{3}\) \d{3}-\d{4})!", got[1])
    assert one, got[1]
    two = re.fullmatch(r"(\+1 \d{3} \d{3} \d{4}) is the same; (\d{4} \d{4} \d{4} \d{4}) and (\d{16}) and (\d{16})%%%", got[2])
    digits = lambda x: re.sub(r"\D", "", x)
    assert digits(two[1]) == digits(one[6]) and digits(two[2]) == two[3] != two[4]
    assert luhn(two[3]) and luhn(two[4]) == luhn("9807915762804490")
    three = re.fullmatch(r"token = \"([0-9a-f]{26})\" password: '([a-z]{6}\d\d[A-Z]{2})' Frau (\w+) (\w+) met Herr (\w+) and Frau (\w+); Госпожа ([А-Я][а-я]+)\.", got[3])
    assert three and three[4] == three[5] == three[6] and three[3] in pii.GIVEN["given_f", "latin"]
    assert got[8].startswith(one[6]) and got[8].endswith(one[6]) and " filler words" * 3000 in got[8]


def test_distinct_even_in_a_small_space(spark):
    rows = [(i, f"host {i // 10}.{i % 10}.0.1 end") for i in range(100)]
    got = [r.text for r in pii.replaced(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(set(got)) == 100 and not set(got) & {t for _, t in rows}
    assert pii.replaced(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_nothing_stays_where_a_format_has_no_room(spark):
    secrets = ["!!@@##$$", "########", "--------1"]
    rows = [(i, f"mail {c}@example.com now") for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")] + [(50 + i, f"token = '{x}' end") for i, x in enumerate(secrets)]
    rows += [(60 + i, f"token = '--------{i}' end") for i in range(10) if i != 1]
    got = {r.doc_id: r.text for r in pii.replaced(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert len(set(got.values())) == len(rows)
    reals = [t.split("'")[1] for i, t in rows if i >= 50]
    for i, _ in rows[:26]:
        assert re.fullmatch(r"mail [a-z]{2,}@example\.com now", got[i]), got[i]
    for i, _ in rows[26:]:
        assert re.fullmatch(r"token = '[^'\s]{8,}' end", got[i]) and not any(real in got[i] for real in reals), got[i]


def test_longer_numbers_keep_their_notation(spark):
    cases = [("phone", "+1 017 555 7713", "+10175557713"), ("phone", "017-555-7713", "0175557713"), ("card", "4111 1111 1111 1111", "4" + "1" * 15), ("ssn", "123-45-6789", "123456789"), ("iban", "DE89 3704 0044 0532 0130 00", "DE89370400440532013000")]
    drawn = spark.createDataFrame(cases, "type string, raw string, norm string").withColumn("new", pii.longer(F.col("type"), F.col("norm"), pii.ROUNDS, F.lit("k")))
    for r in drawn.withColumn("shown", pii._rendered(F.col("raw"), F.col("type"), F.array("new"))).collect():
        shape = "".join({"0": r"\d", "A": "[A-Z]", "+": r"\+"}.get(c, c) for c in re.sub("[A-Z]", "A", re.sub(r"\d", "0", r.raw)))
        assert re.fullmatch(shape + r"\d+", r.shown), r.shown
        assert re.sub("[ -]", "", r.shown) == r.new and r.norm not in r.new


def test_key_decides(spark):
    docs = spark.createDataFrame(ROWS[:1], "doc_id bigint, text string")
    a, b, c = (pii.replaced(docs, key=k).first().text for k in ("one", "one", "two"))
    assert a == b != c


def test_key_is_an_hmac_key_and_in_no_plan(spark):
    for key in ("short", "k" * 100):
        inner, outer = pii.pads(spark, key)
        frame = spark.createDataFrame([("mail|é@x",), ("",)], "m string").withColumns({"inner": inner, "outer": outer}).withColumn("out", pii.hmac(F.col("inner"), F.col("outer"), F.col("m")))
        assert all(r.out == hmac.new(key.encode(), r.m.encode(), hashlib.sha256).hexdigest() for r in frame.collect())
        shown = frame._jdf.queryExecution().toString()
        assert key not in shown and hashlib.sha256(key.encode()).hexdigest() not in shown and "".join(f"{ord(c) ^ 0x36:02X}" for c in key[:5]) not in shown


def test_full_format(spark, monkeypatch):
    """All 676 one-letter addresses of a domain: none stays, all stay distinct (with few rounds, so that most are left over)."""
    monkeypatch.setattr(pii, "ROUNDS", 3)
    abc = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"write to {abc[i // 26]}@{abc[i % 26]}.com now") for i in range(676)]
    got = [r.text for r in pii.replaced(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert len(set(got)) == 676 and not set(got) & {t for _, t in rows}
    assert all(re.fullmatch(r"write to [a-z]+@[a-z.]+\.com now", t) for t in got) and not any(re.search(r"(?<![a-z])[a-z]@[a-z]\.com", t) for t in got)


def test_long_texts(spark):
    """Addresses of 10**5 labels, long runs without an address, and long words end in good time."""
    texts = ["x@" + "a." * 100_000 + "com end", "a." * 200_000, "ab" * 500_000 + " z@y.com", "--- " * 1000 + "-" * 100_000 + "q.r@s.org!", "token = '" + "z" * 200_000, "+1 " * 100_000, "DE89 " + "ABCD " * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in pii.replaced(docs).collect()}
    assert len(got) == len(texts) and got[1] == texts[1] and "z@y.com" not in got[2] and got[4] == texts[4] and got[5] == texts[5]
    assert re.fullmatch(r"(--- ){1000}-{100000}[a-z]\.[a-z]@[a-z]\.org!", got[3]) and "q.r@s.org" not in got[3]
    assert got[0] != texts[0] and got[0].endswith(".com end") and len(got[0]) == len(texts[0])


def test_against_brute_force(spark):
    """Random texts of known entities: everything else stays, one real part has one surrogate, two have two."""
    r = random.Random(14)
    mails = [f"{a}{b}@mail{c}.org" for a in ("jo", "ann", "x") for b in ("", ".doe", "_1") for c in range(3)]
    phones = [f"+1 {n} 555 {m}" for n in (201, 305, 412) for m in (1234, 9876)]
    rows = []
    for d in range(60):
        words = [r.choice([r.choice(mails), r.choice(phones), "plain", "wörter", "(see)", "12"]) for _ in range(r.randint(0, 20))]
        rows.append((d, ", ".join(words)))
    got = {x.doc_id: x.text for x in pii.replaced(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    new = {}
    for d, text in rows:
        before, after = (t.split(", ") for t in (text, got[d]))
        assert len(before) == len(after)
        for x, y in zip(before, after, strict=True):
            if x in mails or x in phones:
                assert new.setdefault(x, y) == y and y not in mails + phones
            else:
                assert x == y
    assert len(set(new.values())) == len(new) > 25
