"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotstream.llm import bpe, chat, decontaminate, langid, linededup, neardup, pii, quality, rules, toxicity
from slotstream.llm.base import fold

ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


ORACLE_SQL["op1_line_dedup"] = r"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i AS pos, ls[i + 1] AS line, list_filter(string_split_regex(lower(ls[i + 1]), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM a, unnest(range(0, len(ls))) AS t(i)),
k AS (SELECT doc_id, pos, doc_id * 1000000 + pos AS seat, w, array_to_string(w, ' ') AS g FROM l WHERE len(w) > 0),
d AS (SELECT g, any_value(w) AS w, min(seat) AS seat FROM k GROUP BY g),
v AS (SELECT g, seat, i, len(w) AS n, array_to_string(list_concat(w[:i - 1], [chr(1)], w[i + 1:]), ' ') AS r, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS s
      FROM d, unnest(range(1, len(w) + 1)) AS t(i) WHERE len(w) >= 8),
near AS (SELECT v.g FROM v JOIN (SELECT r, min(seat) AS m FROM v GROUP BY r) AS x ON x.r = v.r WHERE m < seat
         UNION SELECT v.g FROM v JOIN d ON d.g = v.s WHERE v.n >= 9 AND d.seat < v.seat
         UNION SELECT d.g FROM v JOIN d ON d.g = v.s WHERE v.n >= 9 AND v.seat < d.seat),
gone AS (SELECT doc_id, pos FROM k JOIN d USING (g) WHERE k.seat <> d.seat OR g IN (SELECT g FROM near)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN t.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed
FROM documents AS t JOIN a USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=True)


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, output="digests").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLE_SQL["op4_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM d, (SELECT DISTINCT n FROM bw) AS s, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.g = dw.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS h FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""

def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.classes(docs).withColumnRenamed("id", "doc_id")


ORACLE_SQL["op5_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM d, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

def _held_out(parts: int, part: int):
    return F.coalesce(fold("doc_id", parts) == part, F.lit(False)).alias("held_out")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(fold("doc_id", 3) != 1))
    out = langid.predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", _held_out(3, 1), "lang_pred", "score", "ambiguous")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    return quality.scored(docs, model).select("doc_id", _held_out(5, 0), "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = rules.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    out = rules.judged(docs, field)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return toxicity.scored(docs, model).select("doc_id", _held_out(3, 1), "score", "predicted")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op10_chat_formatting"] = r"""
WITH RECURSIVE a AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS ls FROM conversations),
l AS (SELECT conv_id, turn, i AS pos, ls[i] AS line, len(regexp_replace(regexp_extract(ls[i], '^((?:[ \t]*>)+)[ \t]?', 1), '[^>]', '', 'g')) AS level,
             trim(regexp_replace(lower(regexp_replace(ls[i], '^((?:[ \t]*>)+)[ \t]?', '')), '[ \t\r]+', ' ', 'g')) AS plain FROM a, unnest(range(1, len(ls) + 1)) AS t(i)),
g AS (SELECT *, sum(CASE WHEN plain <> '' AND (was IS NULL OR was = '' OR lev <> level) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS run
      FROM (SELECT *, lag(plain) OVER w AS was, lag(level) OVER w AS lev FROM l WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos))),
ps AS (SELECT conv_id, turn, run, level, string_agg(plain, ' ' ORDER BY pos) AS plain, count(*) AS n FROM g WHERE plain <> '' GROUP BY ALL),
q1 AS (SELECT conv_id, turn, run, level, n, (SELECT max(o.turn) FROM ps AS o WHERE o.conv_id = ps.conv_id AND o.level = 0 AND o.plain = ps.plain AND o.turn < ps.turn) AS source FROM ps WHERE level > 0),
q2 AS (SELECT g.conv_id, g.turn, g.level, 1 AS n, (SELECT max(o.turn) FROM l AS o WHERE o.conv_id = g.conv_id AND o.level = 0 AND o.plain = g.plain AND o.turn < g.turn) AS source
       FROM g JOIN q1 ON q1.conv_id = g.conv_id AND q1.turn = g.turn AND q1.run = g.run WHERE q1.source IS NULL AND g.plain <> ''),
k AS (SELECT conv_id, turn, level, source, sum(n) AS n FROM (SELECT conv_id, turn, level, source, n FROM q1 UNION ALL SELECT conv_id, turn, level, source, n FROM q2) WHERE source IS NOT NULL GROUP BY ALL),
p AS (SELECT conv_id, turn, arg_max(source, n * 1000000000 + source) AS parent_turn FROM k WHERE level = 1 GROUP BY ALL),
up(conv_id, turn, seat, depth, way) AS (SELECT conv_id, turn, turn, 0, [turn] FROM a UNION ALL SELECT up.conv_id, up.turn, p.parent_turn, depth + 1, list_prepend(p.parent_turn, way) FROM up JOIN p ON p.conv_id = up.conv_id AND p.turn = up.seat),
th AS (SELECT conv_id, turn, arg_max(seat, depth) AS thread, max(depth) AS depth, arg_max(way, depth) AS way FROM up GROUP BY ALL),
pl AS (SELECT *, row_number() OVER (PARTITION BY conv_id, thread ORDER BY way) - 1 AS place FROM th),
c AS (SELECT conv_id, turn, sum(n) AS n FROM k GROUP BY ALL),
own AS (SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY pos) FILTER (level = 0) AS text, count(*) FILTER (level > 0) AS n_quoted, max(level) AS max_level FROM l GROUP BY ALL)
SELECT a.conv_id, a.turn, a.role, CASE WHEN a.text IS NULL THEN NULL ELSE trim(coalesce(own.text, '')) END AS text, p.parent_turn, pl.thread, CAST(pl.depth AS BIGINT) AS depth, CAST(pl.place AS BIGINT) AS place,
       CAST(coalesce(own.n_quoted, 0) AS BIGINT) AS n_quoted, CAST(coalesce(c.n, 0) AS BIGINT) AS n_linked, CAST(coalesce(own.max_level, 0) AS BIGINT) AS max_level
FROM a LEFT JOIN own USING (conv_id, turn) LEFT JOIN p USING (conv_id, turn) LEFT JOIN pl USING (conv_id, turn) LEFT JOIN c USING (conv_id, turn)
"""

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_bpe_encoding": op3_bpe_encoding,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_toxicity": op9_toxicity,
    "op10_chat_formatting": op10_chat_formatting,
}
