"""The pipeline on a small corpus: each stage's decision, the columns, and the final encoding."""

import hashlib
import random

import corpus_pipeline
import numpy as np
import test_bpe
import test_decontaminate
import test_linededup
import test_neardup
from slotstream.llm import bpe
from tokenizers import Tokenizer


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(1)
    vocabulary = [f"word{i}" for i in range(300)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows, labels = [], []
    for d in range(120):
        toxic = d % 4 == 0
        body = text(60)
        if toxic:
            body = "moronic " + body + " moronic scumbag"
        rows.append([d, body + "\n" + text(30)])
        labels.append((d, 1, int(toxic)))
    item = text(20)
    rows += [[200, rows[1][1].replace("word1 ", "other1 ", 1)], [201, text(40) + " " + item + " " + text(40)], [202, rows[2][1]], [203, text(50) + "\n" + rows[3][1].split("\n")[1]]]
    frame = spark.createDataFrame([(d, t, "en", "src0", len(t)) for d, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item), (1, text(12))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({x.doc_id: x for x in docs.collect()})
    clean, lines, groups, decontaminated, encoded = seen
    assert set(clean) == {d for d, t in rows if "moronic" not in t}
    assert set(lines) == set(clean) and lines[202].text == "" and lines[203].text == rows[-1][1].split("\n")[0]
    assert set(groups) <= set(lines) and 201 in groups and 1 in groups
    assert set(groups) - set(decontaminated) == {201}
    tokenizer = Tokenizer.from_file(bpe.default_path())
    for d, x in encoded.items():
        ids = tokenizer.encode(decontaminated[d].text, add_special_tokens=False).ids
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(encoded)

def edge_rows(r):
    """Random rows with nulls in every column, empty and long texts, ties and repeated rows."""
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    shared = [text(12) for _ in range(6)]
    rows = [[d, "\n".join(r.choice([text(r.randint(1, 15)), r.choice(shared), ""]) for _ in range(r.randint(1, 5))), "en", "src0", 7] for d in range(80)]
    item = text(15)
    rows += [[100, "a b " + item + " c", "en", None, None], [101, text(4000), None, "s", 1], [102, None, "en", "s", 0], [103, "", "en", "s", 0], [104, None, None, None, None]]
    rows += [[120 + k, base + f" x{k}", "en", "s", 1] for k, base in enumerate([text(60)] * 6)]
    rows += [list(rows[3]), list(rows[3]), [None, text(30), "en", "s", 1], [None, None, None, None, None]]
    return rows, [(0, item), (1, None), (None, text(11)), (2, "")]


def test_stages_against_brute_force(spark, tmp_path):
    """All stages but the first are exact: plain Python gives the same rows, from each stage's own input."""
    rows, items = edge_rows(random.Random(5))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, schema)
    pairs = lambda f: sorted(((x.doc_id, x.text) for x in f.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    lines = stages["line_dedup"](spark, docs, str(tmp_path))
    assert lines.columns == docs.columns and lines.count() == len(rows)
    once = [r for k, r in enumerate(rows) if r[0] is not None and r[:2] not in [x[:2] for x in rows[:k]]]
    alone = {r.doc_id: r.text for r in stages["line_dedup"](spark, spark.createDataFrame(once, schema), str(tmp_path)).collect()}
    assert alone == test_linededup.brute([(r[0], r[1]) for r in once])
    lines.write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    assert all(x.n_chars == (None if x.text is None else len(x.text)) for x in lines.collect())
    unique = [(d, t) for d, t in {(x.doc_id, x.text) for x in docs.collect()} if d is not None]
    near = stages["minhash_near_dedup"](spark, docs, str(tmp_path))
    kept = test_neardup.brute(unique, 80)
    assert pairs(near) == sorted(((r[0], r[1]) for r in rows if r[0] is None or kept[r[0]][2]), key=str) and near.count() < len(rows)
    clean = stages["benchmark_decontamination"](spark, docs, str(tmp_path))
    hit = [test_decontaminate.brute([(0, r[1])], [x for x in items if None not in x])[0][4] for r in rows]
    assert pairs(clean) == sorted(((r[0], r[1]) for r, h in zip(rows, hit, strict=True) if not h), key=str) and sum(hit) == 1
    encoded = stages["bpe_encoding"](spark, docs, str(tmp_path))
    got = sorted(((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in encoded.collect()), key=str)
    assert got == sorted(((r[0], *e) for r, e in zip(rows, test_bpe.expected([r[1] for r in rows]), strict=True)), key=str)


def test_empty_tables_and_missing_labels(spark, tmp_path):
    """No documents give no rows; no labels leave every document in the toxicity stage, nulls and repeated rows too."""
    rows, items = edge_rows(random.Random(6))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "none" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    kept = corpus_pipeline.drop_toxic(spark, spark.createDataFrame(rows, schema), str(tmp_path / "none"))
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.createDataFrame(rows, schema).collect()))
