"""Documents -> sentences, and corpus chunks (PAR-5, SRC-5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplespark import constants as K
from tuplespark.functions.arrays import explode_rows
from tuplespark.functions.text import strip_spaces
from tuplespark.operators.indexing import with_index

# A sentence ends after . ! ? plus closing quotes/brackets, or at a newline.
SENTENCE_RX = r"""[^.!?\n]+[.!?]*["')\]]*"""


def split_sentences(df: DataFrame, text: str = "text", article: str = "articleId",
                    splitter: Callable | None = None) -> DataFrame:
    """PAR-5: one row per sentence ``(articleId, lineId, s)``; ``lineId`` is the
    0-based position in the document.

    ``splitter`` is an optional pandas UDF ``Series[str] -> Series[list[str]]``
    (a plug-in sentence splitter); the default is the native regex above.
    """
    if splitter is None:
        pieces = F.regexp_extract_all(F.col(text), F.lit(SENTENCE_RX), F.lit(0))
    else:
        pieces = splitter(F.col(text))
    sents = F.filter(F.transform(pieces, strip_spaces), lambda x: x != "")
    rest = [c for c in df.columns if c != text]
    return (explode_rows(df, rest, sents, "s", "lineId")
              .withColumn("lineId", F.col("lineId").cast("int")))


def chunk_slice(df: DataFrame, order: list[str], chunk: int | None = None,
                size: int = K.CHUNK_SIZE) -> DataFrame:
    """SRC-5: rows ``[chunk*size, (chunk+1)*size)`` in ``order``; with
    ``chunk=None`` every row gets its ``chunk_id`` (write it with
    ``partitionBy('chunk_id')`` so later reads of one chunk prune files)."""
    idx = with_index(df, order, out="corpus_idx")
    out = idx.withColumn("chunk_id", F.floor(F.col("corpus_idx") / F.lit(size)).cast("bigint"))
    if chunk is not None:
        out = out.where(F.col("chunk_id") == chunk)
    return out


def write_chunks(df: DataFrame, path: str, order: list[str], size: int = K.CHUNK_SIZE, mode: str = "overwrite") -> None:
    """SRC-5: the corpus in chunks of ``size`` rows, one folder per chunk, so
    that reading some chunks opens only their files. Numbering moves the order
    keys only; rows move once, to the task that writes their chunk."""
    chunks = chunk_slice(df, order, size=size)
    chunks.repartition("chunk_id").write.mode(mode).partitionBy("chunk_id").parquet(path)


def read_chunks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Chunks ``first .. last`` of a corpus written by ``write_chunks`` (a
    partition filter: other chunks are not opened)."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.where(F.col("chunk_id") >= first)
    return df if last is None else df.where(F.col("chunk_id") <= last)
