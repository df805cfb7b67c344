"""Helpers shared by the training-data operators: table access, written
intermediates in the shared folder, and sizing of hash blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuplespark.session import scratch_path, ship_package
from tuplespark.sources.tables import table

#: White space of the contracts (space, tab .. carriage return); words are the runs between.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def let(value: str, name: str, body: str) -> str:
    """SQL text that evaluates ``value`` once per row and uses it as ``name``.

    A plain column alias may be inlined by the optimizer into every use, also
    into lambdas, where it would be evaluated once per array element."""
    return f"transform(array({value}), {name} -> {body})[0]"


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only, as the contracts ask (``lower`` folds more)."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Spark drops a query's shuffle files as soon as it ends, instead of when the driver collects garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet under the shared folder and rereads it: lineage
    ends there, columns stay prunable, and a lost executor costs a re-read.
    The shuffles behind it are no longer needed then and are dropped."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: Column, broadcast_mb: float = 8) -> DataFrame:
    """``df``, marked for broadcast when its measured size allows it; else as
    it is, for a shuffle join that AQE splits where it is skewed."""
    size = df.agg(F.sum(row_bytes + F.lit(32))).first()[0] or 0
    return F.broadcast(df) if size <= broadcast_mb * 1e6 else df


def input_mb(spark: SparkSession, df: DataFrame) -> float:
    """Size of ``df`` in MB: the optimizer's estimate from file sizes (no job),
    or, where it has none, the measured bytes of the string columns."""
    mb = float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1e6
    if mb < 1e9:
        return mb
    sizes = [F.sum(F.octet_length(F.col(f"`{c}`"))) for c, kind in df.dtypes if kind == "string"]
    return sum(x or 0 for x in df.agg(*sizes).first()) / 1e6 if sizes else 0.0


def blocks_for(df: DataFrame, mb_each: float = 2.0, least: int = 16) -> int:
    """Number of hash blocks that keeps a block at about ``mb_each`` MB of
    input files, so that it grows with the data and a block stays bounded."""
    return max(least, int(input_mb(df.sparkSession, df) / mb_each) + 1)


__all__ = ["SPACE_BYTES", "WORD", "ascii_lower", "blocks_for", "input_mb", "let", "scratch_path", "ship_package",
           "small", "stored", "table"]
