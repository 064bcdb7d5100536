"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the stage runner writes it as
Parquet and rereads it as the next stage's ``docs``.  All stages but the last return the columns
of ``documents``; the last returns the digests of the encoding.  Every stage takes nulls in any
column, empty and long texts, repeated rows and an empty table: an empty table stays empty, and
what else happens is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotstream.llm import base, bpe, decontaminate, linededup, neardup, toxicity
from slotstream.llm.queries import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least similarity of near-duplicates, in percent of the union (the query op5 is bound to 85).
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator predicts toxic go; it learns from the labels outside the held-out fold.

    A null or empty text holds nothing toxic and stays; repeated rows go or stay together; without
    toxic labels everything stays.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(base.fold("doc_id", 3) != 1))
    return toxicity.scored(docs, model).where("predicted = 0").select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go from the texts; every document stays, if need be with an empty text.

    n_chars follows the text.  A null text stays null (n_chars too); of rows that share id and text
    one keeps its lines, the others repeat them and lose them; rows with a null id come first.
    """
    return linededup.deduplicated(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id; links are 0.8 similar or more.

    Null and empty texts and rows with a null id link with nothing and stay; rows that share an id
    stay or go together.
    """
    return neardup.deduplicated(docs, percent=NEAR_PERCENT).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go; null and empty texts stay, as do all documents without items."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of their decoding: a row for every row, null texts as empty ones."""
    return bpe.encode(docs.select("doc_id", "text"), output="digests").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_documents),
    ("benchmark_decontamination", drop_contaminated),
    ("bpe_encoding", encode),
]

#: Toxicity scores can't be expressed in SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = base.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
