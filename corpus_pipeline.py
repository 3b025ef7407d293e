"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; what it returns is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import _shared, jaccard_join, langid, line_dedup, mixing, packing

#: Rows and bytes of whole texts that go to Python at a time; fewer of them need less memory on either side.
BATCH = {"maxRecordsPerBatch": "1000", "maxBytesPerBatch": "4194304"}
#: A document whose best language is less probable than this is rejected.
LEAST_SCORE = 0.4


def _small_batches(spark: SparkSession) -> None:
    """Let BATCH hold from now on: what a stage returns is worked out after the stage's function has ended."""
    for name, value in BATCH.items():
        spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those with no clear language go.

    Null texts, empty ones and those without a letter go. With no labels to learn from, as in a table whose lang is null throughout, only these go. Very long texts are judged by all of their windows. Repeated rows are judged
    one by one, and alike. Null ids, sources and languages are no reason to go. Columns of any name are kept as they are. An empty table gives none.
    """
    _small_batches(spark)
    net = langid.train(docs)
    text = F.col("text").cast("string")
    if not net.labels:
        return docs.where(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    return docs.where(langid.predictor(net)(text)["score"] >= LEAST_SCORE)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, and documents of which nothing else is left, as of exact copies.

    The first place of a run keeps it: that of the smallest doc_id, null ids last. Of repeated rows, those equal in id and text come out alike. Null and empty texts have no runs, and stay. Very long texts are cut
    like others. Columns of any name, `chunks_removed` among them, are kept as they are. An empty table gives none.
    """
    _small_batches(spark)
    own = docs.toDF(*[c if c in ("doc_id", "text") else f"{i}_" for i, c in enumerate(docs.columns)])  # no name of the input meets one of the operator's
    out = line_dedup.dedup_runs(own).where((F.col("chunks_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*own.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the smallest doc_id, of equal ids the smallest hash of the text; null ids last.

    Of repeated rows one stays. Null texts, empty ones and those without words are like nothing else, and stay. Very long texts are compared as a whole. Columns of any name are kept as they are. An empty table gives none.
    """
    _small_batches(spark)
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it, three times at most.

    A null source is a source, the last; texts without words have size 0 and come with their source's whole copies. Repeated rows share their hash and are taken alike. A very long text counts as one document, so its
    source may miss its target by half of it. Columns of any name are kept as they are. An empty table gives none.
    """
    return mixing.taken_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their places in sequences of 4096.

    A null or empty text is its end mark alone. Very long texts are cut into pieces. Repeated rows are packed each by itself, null ids stay null. Other columns go. An empty table gives none.
    """
    _small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: SQL can't express the trained network, the line hashes or the packing; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus; each stage's tables are deleted when what it returns is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = _shared.count()
    for name, stage in STAGES:
        docs = _shared.written(stage(spark, docs, sf_dir), name)
        _shared.clean(spark, first, docs)
    return docs
