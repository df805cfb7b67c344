"""Corpus pipeline: toxicity, line dedup, MinHash near-dedup, benchmark
decontamination, mixing to target weights.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and reread as the next one's ``docs``. All but the last
return the columns of ``documents``. The result is the mixed corpus: one row
per taken copy with its place in the permutation, text included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplespark.llm import decontam, lines, minhash, mixing, toxicity
from tuplespark.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"), keep=COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents share stay in the largest doc_id only."""
    done = lines.line_dedup(docs, keep=["lang", "source"])
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                       F.length("kept_text").cast("long").alias("n_chars"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; no source is taken more than twice."""
    mixed = mixing.mix(docs, keep=["text", "lang", "n_chars"])
    return mixed.select("doc_id", "carried.*", "source", "copy", "n_tokens", "block", "order_key")


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("minhash", dedup_documents),
          ("decontamination", drop_contaminated), ("mixing", mix_sources)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs


#: The toxicity stage learns a model, which SQL cannot express; see tests/llm/test_models_and_pages.py.
ORACLE_SQL = None
