"""Chain B, predict over a corpus: documents -> chunk -> sentences -> prompts ->
[generate | replay] -> tuples -> published fact table.

No shuffle is needed apart from the corpus index used for chunking; the
generator runs where the rows are (``mapInPandas``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplespark.functions.parse import parse_tuples
from tuplespark.operators.facts import explode_facts, widen_objects, with_ident
from tuplespark.operators.generate import generate
from tuplespark.operators.prompts import build_messages, render_messages
from tuplespark.operators.sentences import chunk_slice, read_chunks, split_sentences
from tuplespark.sources.corpus import write_facts


def prompts(docs: DataFrame, shots: str = "none", chunk: int | None = None, chunk_size: int | None = None) -> DataFrame:
    """``(articleId, lineId, ident, s, prompt)`` for every sentence (of one
    chunk when ``chunk`` is given)."""
    d = docs.select(F.col("id").alias("articleId"), "text")
    if chunk is not None:
        d = chunk_slice(d, ["articleId"], chunk, chunk_size or 10000).drop("corpus_idx", "chunk_id")
    s = with_ident(split_sentences(d, "text", "articleId"))
    m = build_messages(s, "s", shots=shots)
    return m.select("articleId", "lineId", "ident", "s", render_messages(F.col("messages")).alias("prompt"))


def predict(docs: DataFrame, make_fn: Callable, shots: str = "none", batch: int = 64,
            chunk: int | None = None, chunk_size: int | None = None) -> DataFrame:
    """Published facts: ``articleId, lineId, factId, text, subj, pred, auxi,
    prep1..obj5, n_objs`` (plus ``ident``)."""
    gen = generate(prompts(docs, shots, chunk, chunk_size), "prompt", make_fn, out="output", batch=batch)
    parsed = parse_tuples(gen.select("articleId", "lineId", "ident", "output"), "output")
    return widen_objects(explode_facts(parsed.drop("output")))


def predict_chunks(spark: SparkSession, corpus: str, out: str, make_fn: Callable, first: int | None = None,
                   last: int | None = None, shots: str = "none", batch: int = 64) -> None:
    """The chunked run: facts of the chunks ``first .. last`` of a corpus
    written by ``write_chunks``, one output folder per chunk. A chunk that is
    run again replaces its own folder only."""
    docs = read_chunks(spark, corpus, first, last).select(F.col("id").cast("string").alias("articleId"), "text", "chunk_id")
    sents = with_ident(split_sentences(docs, "text", "articleId"))
    asked = build_messages(sents, "s", shots=shots).select(
        "articleId", "lineId", "ident", "chunk_id", render_messages(F.col("messages")).alias("prompt"))
    gen = generate(asked, "prompt", make_fn, out="output", batch=batch)
    parsed = parse_tuples(gen.select("articleId", "lineId", "ident", "chunk_id", "output"), "output")
    facts = widen_objects(explode_facts(parsed.drop("output")))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        write_facts(facts, out, partition_by=["chunk_id"])
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
