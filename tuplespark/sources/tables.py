"""Driver tables: one parquet file per table under an sf directory."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """SRC-4: the document corpus as ``(id, url, title, text)``.

    The driver's ``documents`` table is bound as ``doc_id -> id``; it has no
    url or title, which stay NULL.
    """
    df = spark.read.format(fmt).load(path)
    cols = set(df.columns)
    from pyspark.sql import functions as F
    if "id" not in cols and "doc_id" in cols:
        df = df.withColumn("id", F.col("doc_id").cast("string"))
    for c in ("url", "title"):
        if c not in cols:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df
