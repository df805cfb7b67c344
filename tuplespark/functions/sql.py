"""UDF-5: the tuple parser as SQL functions.

``parse_tuples(text)`` (scalar, returns the tuple array) and
``parse_tuples_table(text)`` (table function, one row per tuple) are SQL
functions: Catalyst inlines their bodies, so SQL users get the same native
plan as the DataFrame operator ``functions.parse.parse_tuples``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Every split runs once: its result is bound by a one-element transform. A later
# line that is digits without a dot has no parts and is dropped either way (P4, P5).
PARSE_EXPR = r"""
transform(
  filter(
    transform(
      filter(
        transform(array_distinct(filter(split(lower({text}), '\n', -1), s -> trim(s) <> '')),
                  (s, i) -> CASE WHEN i = 0 THEN s
                                 WHEN s rlike '^[0-9]+[.]' THEN substring(s, instr(s, '.') + 1) END),
        b -> b IS NOT NULL),
      b -> split(b, ',,', -1)),
    p -> size(p) >= 2),
  p -> transform(array(transform(split(p[1], '###', -1), x -> trim(x))), a -> named_struct(
    'subj', trim(p[0]),
    'pred', element_at(a, -1),
    'auxi', slice(a, 1, size(a) - 1),
    'objs', transform(transform(slice(p, 3, greatest(size(p) - 2, 0)), o -> split(o, '###', -1)),
                      q -> CASE WHEN size(q) = 1 THEN named_struct('prep', '', 'obj', trim(q[0]))
                                ELSE named_struct('prep', trim(element_at(q, -2)), 'obj', trim(element_at(q, -1))) END)))[0])
"""

def parse_expr(column: str) -> str:
    """The parser applied to ``column`` (a column or parameter name)."""
    return PARSE_EXPR.replace("{text}", column)


TUPLE_DDL = "STRUCT<subj: STRING, pred: STRING, auxi: ARRAY<STRING>, objs: ARRAY<STRUCT<prep: STRING, obj: STRING>>>"


def register_sql_functions(spark: SparkSession) -> None:
    """Create the temporary SQL functions in this session."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION parse_tuples(text STRING) "
              f"RETURNS ARRAY<{TUPLE_DDL}> RETURN {parse_expr('text')}")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION parse_tuples_table(text STRING)
        RETURNS TABLE (tidx INT, subj STRING, pred STRING, auxi ARRAY<STRING>, objs ARRAY<STRUCT<prep: STRING, obj: STRING>>)
        RETURN SELECT pos AS tidx, col.subj AS subj, col.pred AS pred, col.auxi AS auxi, col.objs AS objs
               FROM (SELECT posexplode({parse_expr('text')}))""")
