"""PII surrogates: keyed, type-consistent replacements for personal data, with DataFrame functions only.

Detected: e-mail addresses, IPv4 addresses, telephone, payment-card and social-security numbers,
IBANs, quoted secrets after a name such as ``token =``, and people named with a title.

Every entity is cut into parts (one, or one for each name of a person).  A part's surrogate is drawn
from an HMAC-SHA256 of its type and normalised form under the secret ``key``, in the same format: digits for
digits, letters for letters of the same case and script, octets of the same length, card numbers
with the same checksum verdict, given names of the title's gender.  All mentions of a part get one
surrogate (coreference: a phone number in two notations, a surname with and without given name).

Collision checks over the whole corpus keep distinct parts distinct: where two parts would share a
surrogate, or a surrogate would equal a real part, the losers draw again (more room on each round).
What a format has no room for gets a longer surrogate from the keyed hash alone; nothing stays in clear.

Only the entities leave the text; they return by a join on the document, so that no text is
grouped.  All patterns take time in proportion to the text: what may repeat without bound does so
possessively, and an address is tried once for each run of its characters.  The key reaches the
executors as the value of a subquery, so that no plan or event log shows it.

Defined cases: null and empty texts stay as they are; text without entities is unchanged to the
byte; rows that share id and text get the same result, whatever the id, null included; an empty
table gives an empty result; extra columns of any name pass through, but that one named
``n_entities`` gives way where counts are asked for.  People are found only behind a title.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotstream.llm import base

#: The public default key is for tests; production passes a secret one.
DEFAULT_KEY = "slotstream"
ROUNDS = 16
#: Rounds of longer draws after those.
SPARE = 4
MALE, FEMALE = "Mr|Mister|Herr|Monsieur|Señor|Sr|Господин", "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Госпожа"
_LOCAL = r"[\p{L}\p{N}._%+-]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    # Leading punctuation of an address is matched with it and put back.
    "email": rf"(?:(?<!{_LOCAL})|\G)[._%+-]*+[\p{{L}}\p{{N}}]{_LOCAL}*+@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)++",
    "secret": r"(?<=(?:token|secret|password|passwd|api_key|apikey|api-key) {0,3}[=:] {0,3}[\"'])[^\"'\s]{8,}+(?=[\"'])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "phone": r"(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
    "card": r"(?<!\w)(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "person": rf"(?<!\p{{L}})(?:{FEMALE}|{MALE})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+)?(?!\p{{L}})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

#: Name stock; surnames are built from syllables.
GIVEN = {
    ("given_f", "latin"): "Anna Clara Emma Helen Irene Julia Laura Maria Nora Paula Rosa Sophie Teresa Vera Alice Carmen".split(),
    ("given_m", "latin"): "Adam Bruno Carl David Erik Felix Hugo Ivan Jonas Lukas Martin Oscar Paul Robert Simon Victor".split(),
    ("given_f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("given_m", "cyrillic"): "Борис Виктор Глеб Денис Иван Лев Олег Павел".split(),
}
HEADS = {"latin": "Bar Cal Dor El Far Gal Hol Kal Lor Mar Nor Pal Ran Sal Tor Val".split(), "cyrillic": "Бар Вол Гор Дан Зар Кол Лан Мар Нор Пол Рад Сел".split()}
MIDDLES = {"latin": "a be di en go ha ki lo mi ne or ra si ta ul ve".split(), "cyrillic": "а бе ви го да ле ми но ра си то у".split()}
SYMBOLS = "!#$%&*+-/:<=>?^~"
TAILS = {"latin": "berg dale field land lund man mond nell ridge sen son stein ton vale well wick".split(), "cyrillic": "ов ев ин ский енко ич ко ман".split()}


def entities(text: Column) -> Column:
    """All entities of a text in order (repeats included)."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind(raw: Column) -> Column:
    """Type of an entity by its own form; what has no other form is a secret."""
    out = F.lit("secret")
    for name in ("person", "iban", "ssn", "phone", "card", "ip", "email"):
        out = F.when(raw.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(out)
    return out


def parts(raw: Column, name: Column) -> Column:
    """(type, norm) of each part of an entity."""
    part = lambda t, n: F.struct(t.alias("type"), n.alias("norm"))
    digits = F.regexp_replace(raw, r"\D", "")
    gender = F.when(raw.rlike(rf"^(?:{FEMALE})(?!\p{{L}})"), F.lit("given_f")).otherwise(F.lit("given_m"))
    names = F.split(F.regexp_replace(raw, r"^\p{L}+\.? ", ""), "[ -]")
    person = F.transform(names, lambda w, i: part(F.when(i == F.size(names) - 1, F.lit("surname")).otherwise(gender), F.lower(w)))
    one = F.when(name == "phone", F.concat(F.when(raw.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits)).when(name.isin("card", "ssn"), digits).when(name == "email", F.lower(F.regexp_replace(raw, r"^[._%+-]+", ""))).when(name == "iban", F.regexp_replace(raw, " ", "")).otherwise(raw)
    return F.when(name == "person", person).otherwise(F.array(part(name, one)))


def pads(spark: SparkSession, key: str) -> tuple[Column, Column]:
    """The inner and outer pad of an HMAC under ``key``, as one-row subqueries: their values are in no plan."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    row = spark.createDataFrame([(bytearray(c ^ 0x36 for c in raw), bytearray(c ^ 0x5C for c in raw))], "inner binary, outer binary")
    return row.select("inner").scalar(), row.select("outer").scalar()


def hmac(inner: Column, outer: Column, message: Column) -> Column:
    """HMAC-SHA256 of a string, in hexadecimal."""
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _draw(seed: Column, i: Column | int, size: int) -> Column:
    """A number in 0..size-1 for place ``i``, from a part's keyed ``seed``."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed, (F.lit(i) if isinstance(i, int) else i).cast("string")), 256), 1, 12), 16, 10).cast("bigint") % size


def _pick(stock: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in stock]), (at + 1).cast("int"))


def _letters(seed: Column, body: Column, hexadecimal: Column) -> Column:
    """``body`` with each digit and letter drawn anew within its class and script; the rest kept."""
    chars = F.filter(F.split(body, ""), lambda c: c != "")
    take = lambda stock, i: F.substr(F.lit(stock), (_draw(seed, i, len(stock)) + 1).cast("int"), F.lit(1))

    def one(c: Column, i: Column) -> Column:
        out = F.when(hexadecimal & c.rlike("[0-9a-f]"), take("0123456789abcdef", i))
        for pattern, stock in ((r"[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[а-яё]", "абвгдежзиклмнопрстуфхцчшщэюя"), ("[А-ЯЁ]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"), (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (r"\p{L}", "abcdefghijklmnopqrstuvwxyz")):
            out = out.when(c.rlike(pattern), take(stock, i))
        return out.otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _symbols(seed: Column, n: Column) -> Column:
    """``n`` drawn symbols."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.lit(SYMBOLS), (_draw(seed, i, len(SYMBOLS)) + 1).cast("int"), F.lit(1))), "")


def luhn_sum(digits: Column) -> Column:
    """Checksum total of a digit string; a multiple of ten passes."""
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def surrogate(kind: Column, norm: Column, attempt: int, seed: Column) -> Column:
    """The surrogate of a part on its ``attempt``-th draw, in normalised form."""
    plain = _letters(seed, norm, F.lit(False))
    reserved = norm.rlike(r"[@.]example\.(?:com|net|org)$")
    head = F.when(reserved, F.regexp_extract(norm, r"^(.*[@.])example\.\w+$", 1)).otherwise(F.regexp_extract(norm, r"^(.*\.)[^.]+$", 1))
    tail = F.when(reserved, F.regexp_extract(norm, r"(example\.\w+)$", 1)).otherwise(F.regexp_extract(norm, r"([^.]+)$", 1))
    email = F.concat(_letters(seed, head, F.lit(False)), tail)
    lowest, highest = (lambda n: F.when(n == 1, 0).when(n == 2, 10).otherwise(100)), (lambda n: F.when(n == 1, 9).when(n == 2, 99).otherwise(255))
    octet = lambda c, i: (F.lit(0) + _draw(seed, i, 256)) if attempt > 8 else lowest(F.length(c)) + F.pmod(_draw(seed, i, 1 << 40), highest(F.length(c)) - lowest(F.length(c)) + 1)
    ip = F.array_join(F.transform(F.split(norm, r"\."), lambda c, i: octet(c, i).cast("string")), ".")
    body = F.concat(F.substring(norm, 1, 1), F.expr("''"), _letters(seed, F.expr("substring(norm, 2, length(norm) - 2)"), F.lit(False)))
    check = F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    wrong = F.pmod(check + 1 + _draw(seed, 99, 9), F.lit(10))
    card = F.concat(body, F.when(luhn_sum(norm) % 10 == 0, check).otherwise(wrong).cast("string"))
    phone = F.when(norm.startswith("+"), F.concat(F.substring(norm, 1, 2), _letters(seed, F.expr("substring(norm, 3)"), F.lit(False)))).otherwise(plain)
    iban = F.concat(F.substring(norm, 1, 2), _letters(seed, F.expr("substring(norm, 3)"), F.lit(False)))
    secret = F.when(norm.rlike("^[0-9a-f]+$"), _letters(seed, norm, F.lit(True))).when(~norm.rlike(r"[\p{L}0-9]"), _symbols(seed, F.length(norm))).otherwise(plain)
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "iban", iban).when(kind == "ssn", plain)
    for script, here in (("cyrillic", norm.rlike("[а-яё]")), ("latin", ~norm.rlike("[а-яё]"))):
        for gender in ("given_f", "given_m"):
            stock = GIVEN[gender, script]
            more = [_pick(MIDDLES[script], _draw(seed, 10 + k, len(MIDDLES[script]))) for k in range(attempt)]
            out = out.when((kind == gender) & here, F.lower(F.concat(_pick(stock, _draw(seed, 0, len(stock))), *more)))
        middles = [_pick(MIDDLES[script], _draw(seed, 10 + k, len(MIDDLES[script]))) for k in range(1 + attempt)]
        out = out.when((kind == "surname") & here, F.lower(F.concat(_pick(HEADS[script], _draw(seed, 0, len(HEADS[script]))), *middles, _pick(TAILS[script], _draw(seed, 1, len(TAILS[script]))))))
    return out.otherwise(secret)


def longer(kind: Column, norm: Column, attempt: int, seed: Column) -> Column:
    """A part's surrogate where its own format has no room left: drawn with more characters, none of them the part's."""
    drawn = lambda like: _letters(seed, F.lit(like), F.lit(False))
    phone = F.concat(F.when(norm.startswith("+"), F.lit("+")).otherwise(F.lit("")), drawn("0" * 24))
    secret = F.when(norm.rlike(r"[\p{L}0-9]"), drawn("a0" * 12)).otherwise(_symbols(seed, F.lit(24)))
    out = F.when(kind == "email", F.concat(drawn("a" * 16), F.lit("@example.com"))).when(kind == "phone", phone).when(kind.isin("card", "ssn"), drawn("0" * 24))
    out = out.when(kind == "iban", drawn("AA" + "0" * 32)).when(kind == "secret", secret)
    return out.otherwise(surrogate(kind, norm, attempt, seed))


def resolved(found: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(type, norm, surrogate) of distinct parts (type, norm); surrogates are distinct and no real part."""
    real = found.select("type", F.col("norm").alias("surrogate"))
    todo, done = found, None
    inner, outer = pads(found.sparkSession, key)
    for attempt in range(ROUNDS + SPARE):
        draw = surrogate if attempt < ROUNDS else longer
        salt = F.concat_ws("|", "type", "norm", F.lit(str(attempt)))
        drawn = todo.withColumns({"inner": inner, "outer": outer}).withColumn("seed", hmac(F.col("inner"), F.col("outer"), salt))
        drawn = drawn.withColumn("surrogate", draw(F.col("type"), F.col("norm"), attempt, F.col("seed")))
        first = drawn.groupBy("type", "surrogate").agg(F.min("norm").alias("norm")).join(real, ["type", "surrogate"], "left_anti")
        if done is not None:
            first = first.join(done.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        new = first.select("type", "norm", "surrogate")
        done = base.written(new if done is None else done.union(new), "surrogates")
        todo = base.written(found.join(done, ["type", "norm"], "left_anti"), "todo")
        if not todo.limit(1).count():
            return done
    raise RuntimeError("parts without a surrogate after all rounds")


def _rendered(raw: Column, name: Column, new: Column) -> Column:
    """The entity ``raw`` with its parts' surrogates in its own notation."""
    first = F.element_at(new, 1)
    digits = F.regexp_replace(first, r"\D", "")
    chars = F.filter(F.split(raw, ""), lambda c: c != "")
    filled = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(digits, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x.rlike("[0-9]"))), F.lit(1))).otherwise(c)), "")
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substr(first, F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x != " ")), F.lit(1)))), "")
    # A longer surrogate ends in what the notation has no places for.
    filled = F.concat(filled, F.substr(digits, F.length(F.regexp_replace(raw, r"[^0-9]", "")) + 1))
    spaced = F.concat(spaced, F.substr(first, F.length(F.regexp_replace(raw, " ", "")) + 1))
    cased = F.concat(F.regexp_extract(raw, r"^[._%+-]*", 0), F.when(F.upper(raw) == raw, F.upper(first)).otherwise(first))
    between = F.regexp_extract(raw, r"^\p{L}+\.? \p{L}+([ -]?)", 1)
    second = F.when(F.size(new) > 1, F.concat(between, F.initcap(F.element_at(new, 2)))).otherwise(F.lit(""))
    person = F.concat(F.regexp_extract(raw, r"^(\p{L}+\.? )", 1), F.initcap(first), second)
    return F.when(name.isin("phone", "card", "ssn"), filled).when(name == "iban", spaced).when(name == "person", person).when(name == "email", cased).otherwise(first)


def replaced(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = DEFAULT_KEY, counts: bool = False) -> DataFrame:
    """``docs`` with surrogates for all entities in the text; ``counts`` adds n_entities."""
    names = base.without(docs, ["n_entities"]) if counts else docs.columns
    doc = F.struct(*[F.col(f"`{n}`") for n in names]).alias("doc")
    rows = docs.select(doc, F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(f"`{text_col}`").alias("part"))
    # Cheap tests first: most texts can't hold an entity.
    likely = F.col("text").rlike(rf"[0-9@]|[=:] {{0,3}}[\"']|(?:{FEMALE}|{MALE})\.? \p{{Lu}}")
    found = rows.where(likely).select("id", "part", F.array_distinct(entities(F.col("text"))).alias("raws")).where(F.size("raws") > 0).distinct()
    found = base.written(found.select("id", "part", F.explode("raws").alias("raw")), "entities")
    raws = found.select("raw").distinct().withColumn("kind", kind(F.col("raw"))).withColumn("parts", parts(F.col("raw"), F.col("kind")))
    raws = base.written(raws, "raws")
    each = base.written(raws.select("raw", F.posexplode("parts").alias("i", "p")).select("raw", "i", "p.type", "p.norm"), "parts")
    new = base.written(resolved(base.written(each.select("type", "norm").distinct(), "distinct"), key), "resolved")
    joined = each.join(base.sized(new), ["type", "norm"]).groupBy("raw").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "surrogate"))), lambda x: x["surrogate"]).alias("new"))
    shown = base.written(raws.join(joined, "raw").select("raw", _rendered(F.col("raw"), F.col("kind"), F.col("new")).alias("shown")), "shown")
    by_doc = found.join(base.sized(shown), "raw").groupBy("id", "part").agg(F.map_from_entries(F.collect_list(F.struct("raw", "shown"))).alias("new"))
    by_doc = base.written(by_doc.withColumnsRenamed({"id": "eid", "part": "epart"}), "by-doc")
    out = rows.join(base.sized(by_doc), F.col("id").eqNullSafe(F.col("eid")) & (F.col("part") == F.col("epart")), "left")
    text = F.col("text")
    whole = F.zip_with(F.split(text, ANY, -1), F.transform(entities(text), lambda m: F.element_at("new", m)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    new_text = F.when(F.col("new").isNull(), text).otherwise(F.array_join(whole, ""))
    columns = [new_text.alias(n) if n.lower() == text_col.lower() else F.col(f"doc.`{n}`") for n in names]
    if counts:
        columns.append(F.when(F.col("new").isNull(), F.lit(0)).otherwise(F.size(entities(text))).cast("bigint").alias("n_entities"))
    return out.select(*columns)
