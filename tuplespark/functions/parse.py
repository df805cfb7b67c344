"""Text -> tuple parsers, written as native higher-order functions.

``subj ,, [auxi ###] pred ,, [prep ###] obj ...``); ``parse_annotation`` follows
A1-A6 (annotation replies, ``[auxi ###] pred ;; subj ;; ...``). Each step is
projected into its own column so Catalyst does not re-evaluate shared
sub-expressions inside lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplespark import constants as K
from tuplespark.functions.text import strip_spaces

DIGITS = "^[0-9]+$"


def _last(a: Column) -> Column:
    return F.get(a, F.size(a) - 1)


def _but_last(a: Column) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))


def _after_first_dot(s: Column) -> Column:
    pieces = F.split(s, "[.]", -1)
    return F.array_join(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), ".")


def parse_tuples(df: DataFrame, col: str, out: str = "triples") -> DataFrame:
    """PAR-1: generated text -> ``array<struct<subj,pred,auxi,objs>>``.

    P1 lowercase; P2 split on newline, drop space-only and duplicate lines
    (first kept); P3 the first kept line is used as is; P4 later lines need
    digits before the first ``.``, which are cut; P5 fewer than two ``,,``
    parts -> dropped; P6-P8 subject / predicate with auxiliaries / objects;
    P9 order kept, no dedupe of tuples.

    One projection of the SQL form of the rules (``functions.sql``), the
    same expression the SQL function ``parse_tuples`` inlines; building it
    from text is one call instead of thousands of small ones.
    """
    from tuplespark.functions.sql import parse_expr
    return df.withColumn(out, F.expr(parse_expr("`" + col.replace("`", "``") + "`")))


# --- annotation replies (PAR-2) --------------------------------------------

def _anno_object(o: Column) -> Column:
    pieces = F.transform(F.split(o, K.INNER_SPLIT, -1), strip_spaces)
    return F.when(o.contains(K.INNER_SPLIT), F.struct(F.get(pieces, 0).alias("prep"),
                                                      F.get(pieces, 1).alias("obj"))).otherwise(
        F.struct(F.lit("").alias("prep"), o.alias("obj")))


def _anno_tuple(parts: Column) -> Column:
    p0 = F.get(parts, 0)
    pieces = F.transform(F.split(p0, K.INNER_SPLIT, -1), strip_spaces)
    has = p0.contains(K.INNER_SPLIT)
    return F.struct(
        F.get(parts, 1).alias("subj"),
        F.when(has, _last(pieces)).otherwise(p0).alias("pred"),
        F.when(has, _but_last(pieces)).otherwise(F.array().cast("array<string>")).alias("auxi"),
        F.transform(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), _anno_object).alias("objs"),
    )


def annotation_lines(text: Column) -> Column:
    """FLT-5: reply lines of length >= 5 whose first character is a digit,
    as ``struct<line, item, parts>`` (A2, A3)."""
    lines = F.filter(F.split(text, "\n", -1),
                     lambda s: (F.length(s) >= K.MIN_ANNOTATION_LINE) & F.substring(s, 1, 1).rlike("^[0-9]$"))
    return F.transform(lines, lambda s: F.struct(
        s.alias("line"),
        F.get(F.split(s, "[.]", -1), 0).alias("item"),
        F.split(_after_first_dot(s), K.PRED_FIRST_SEP, -1).alias("parts")))


def parse_annotation(df: DataFrame, col: str, out: str = "triples") -> DataFrame:
    """PAR-2: annotation reply -> tuples (A1-A6). Lines without a subject part
    (an ``IndexError`` in the reference) are left out here and reported by
    ``operators.corpus.violations``."""
    tmp = f"__{out}_alines"
    return (df.withColumn(tmp, annotation_lines(F.col(col)))
              .withColumn(out, F.transform(F.filter(F.col(tmp), lambda r: F.size(r["parts"]) >= 2),
                                           lambda r: _anno_tuple(r["parts"])))
              .drop(tmp))
