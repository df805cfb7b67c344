"""Sentence keys and the published flat fact table (PRJ-1, PRJ-2, PAR-3, PAR-4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespark import constants as K
from tuplespark.functions.arrays import explode_rows
from tuplespark.functions.text import linearize


def with_ident(df: DataFrame, article: str = "articleId", line: str = "lineId",
               out: str = "ident") -> DataFrame:
    """PRJ-1: ``articleId_lineId``, or ``''`` when there is no article id."""
    return df.withColumn(out, F.when(F.col(article).isNotNull(),
                                     F.concat_ws("_", F.col(article), F.col(line).cast("string")))
                         .otherwise(F.lit("")))


def split_ident(df: DataFrame, ident: str = "ident") -> DataFrame:
    """PRJ-2: split at the last ``_`` (article ids may contain ``_``)."""
    rx = r"^(.*)_([^_]*)$"
    return (df.withColumn("articleId", F.regexp_extract(F.col(ident), rx, 1))
              .withColumn("lineId", F.regexp_extract(F.col(ident), rx, 2).try_cast("int")))


def explode_facts(df: DataFrame, triples: str = "triples") -> DataFrame:
    """PAR-3: one row per tuple; ``factId`` is its 0-based position."""
    rest = [c for c in df.columns if c != triples]
    return explode_rows(df, rest, triples, "fact", "factId")


def widen_objects(df: DataFrame, fact: str = "fact", n: int = K.FACT_OBJECTS) -> DataFrame:
    """PAR-4: tuple struct -> ``text, subj, pred, auxi, prep1, obj1 .. prepN, objN``
    plus ``n_objs`` (objects beyond N are counted, not published, R7)."""
    f = F.col(fact)
    cols = [linearize(f).alias("text"), f["subj"].alias("subj"), f["pred"].alias("pred"),
            F.array_join(f["auxi"], " ").alias("auxi")]
    for i in range(n):
        o = F.get(f["objs"], i)
        cols += [o["prep"].alias(f"prep{i + 1}"), o["obj"].alias(f"obj{i + 1}")]
    cols.append(F.size(f["objs"]).alias("n_objs"))
    rest = [c for c in df.columns if c != fact]
    return df.select(*rest, *cols)
