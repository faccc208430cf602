"""Corpus cleaning: five stages from raw documents to tokens, each on all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as
Parquet and reads again as the next one's docs. All but the last return the columns of documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatialscore.llm import bpe, decontam, langid, linedup, neardup
from spatialscore.llm.common import stored, table
from spatialscore.llm.queries import tokenizer_path

MIN_WORDS = 50


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; texts without letters or with a margin too narrow for their length go."""
    model = langid.fit(docs)
    return docs.withColumn("_r", langid.identify(docs, model)).where("NOT _r.rejected").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of line runs of 50 words or more; documents that lose every line go."""
    out = linedup.dedup_lines(docs, min_words=MIN_WORDS)
    changed = F.col("_removed") > 0
    size = F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None
    out = out.where((F.col("_removed") == 0) | (F.col("_removed") < F.col("_lines")))
    return (out.withColumn("n_chars", size) if size is not None else out).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, on 5-word shingles at similarity 0.8.

    Rows that repeat an id are one document and all stay or go with it.
    """
    found = neardup.near_duplicates(docs, neardup.Settings(shingle=5, percent=80))
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of 10 words with a benchmark item."""
    found = decontam.hits(docs, table(spark, sf_dir, "benchmark"))
    gone = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every kept document."""
    return bpe.digests(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("tokenize", tokenize)]

#: Language identification by compression and BPE can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
