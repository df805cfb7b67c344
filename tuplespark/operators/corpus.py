"""Gold-corpus conversion and annotation (PRJ-3, PRJ-7, AGG-1, FLT-5..7,
JON-3, SET-3, SPL-1, SPL-2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuplespark import constants as K
from tuplespark.functions.arrays import explode_rows
from tuplespark.functions.parse import annotation_lines
from tuplespark.operators.indexing import with_index
from tuplespark.session import materialize


def to_template(df: DataFrame, n_objects: int = K.TEMPLATE_OBJECTS) -> DataFrame:
    """PRJ-3: ``(sent, pred, args)`` -> annotation template: subject = first
    argument, ``obj0..obj{n-1}`` = ``('', arg)`` padded with ``('', '')``;
    arguments after the fourth are dropped (and reported by ``violations``)."""
    objs = [F.struct(F.lit("").alias("prep"),
                     F.coalesce(F.get(F.col("args"), i + 1), F.lit("")).alias("obj")).alias(f"obj{i}")
            for i in range(n_objects)]
    rest = [c for c in df.columns if c not in ("sent", "pred", "args")]
    return df.select(*rest, "sent", "pred", F.get(F.col("args"), 0).alias("subj"), *objs,
                     F.lit("").alias("auxilliary"))


def group_by_sentence(df: DataFrame, sent: str = "sent", pos: str = "line_no",
                      record: list[str] | None = None) -> DataFrame:
    """AGG-1: a sentence's records in file order, plus ``sidx`` = rank of the
    sentence's first appearance (0-based, distributed index)."""
    record = record or ["pred", "args"]
    # Written once: numbering reads it for the keys and again for the rows. The numbers are written
    # as well, so every reader of the result sees the same.
    grouped = materialize(df.groupBy(sent)
                 .agg(F.min(pos).alias("first_pos"),
                      F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), *record))).alias("records"))
                 .withColumn("__group", F.monotonically_increasing_id()))
    numbers = materialize(with_index(grouped.select("__group", "first_pos"), ["first_pos"], out="sidx")
                          .select("__group", F.col("sidx").cast("int").alias("sidx")))
    return grouped.join(numbers, "__group").drop("__group")


def render_annotation_prompt(df: DataFrame, records: str = "records", sent: str = "sent",
                             header: str = K.ANNOTATION_HEADER, after_once: bool = False,
                             out: str = "prompt") -> DataFrame:
    """PRJ-7: header + sentence + ``Before:`` list of ``n. pred ;; arg ;; ...``.

    R3: by default ``\\n\\nAfter:`` follows every record, as in the reference;
    ``after_once=True`` writes it once at the end.
    """
    def item(r: Column, i: Column) -> Column:
        body = F.array_join(F.concat(F.array(r["pred"]), r["args"]), K.PRED_FIRST_SEP)
        tail = F.lit("\n") if after_once else F.lit("\n\nAfter:")
        return F.concat((i + 1).cast("string"), F.lit(". "), body, tail)
    items = F.array_join(F.transform(F.col(records), item), "")
    suffix = F.lit("\nAfter:") if after_once else F.lit("")
    return df.withColumn(out, F.concat(F.lit(header), F.col(sent), F.lit("\n\nBefore:\n"), items, suffix))


def valid_reply(c: Column) -> Column:
    """FLT-6: replies shorter than 10 characters are rejected."""
    return F.length(c) >= K.MIN_REPLY_CHARS


def reply_violations(df: DataFrame, reply: str, key: list[str]) -> DataFrame:
    """FLT-7 (replies): one row per problem ``(key.., item_idx, rule, detail)``.

    Rules: ``item_not_numeric`` (kept, A2), ``pred_pieces`` (``###`` splits the
    predicate into other than 2 pieces), ``subj_has_sep``, ``obj_pieces``,
    ``no_subject`` (line left out by the parser, A5)."""
    lines = explode_rows(df, key, annotation_lines(F.col(reply)), "r", "item_idx")
    r = F.col("r")
    p0, p1 = F.get(r["parts"], 0), F.get(r["parts"], 1)
    n_pred = F.size(F.split(p0, K.INNER_SPLIT, -1))
    bad_objs = F.filter(F.slice(r["parts"], 3, F.greatest(F.size(r["parts"]) - 2, F.lit(0))),
                        lambda o: o.contains(K.INNER_SPLIT) & (F.size(F.split(o, K.INNER_SPLIT, -1)) != 2))
    checks = F.array(
        F.when(~r["item"].rlike("^[0-9]+$"), F.struct(F.lit("item_not_numeric").alias("rule"), r["line"].alias("detail"))),
        F.when(p0.contains(K.INNER_SPLIT) & (n_pred != 2), F.struct(F.lit("pred_pieces").alias("rule"), p0.alias("detail"))),
        F.when(F.size(r["parts"]) < 2, F.struct(F.lit("no_subject").alias("rule"), r["line"].alias("detail"))),
        F.when(p1.contains(K.INNER_SPLIT), F.struct(F.lit("subj_has_sep").alias("rule"), p1.alias("detail"))),
        F.when(F.size(bad_objs) > 0, F.struct(F.lit("obj_pieces").alias("rule"), F.array_join(bad_objs, K.PRED_FIRST_SEP).alias("detail"))),
    )
    return (explode_rows(lines.withColumn("item_idx", F.col("item_idx").cast("bigint")), key + ["item_idx"],
                         F.filter(checks, lambda x: x.isNotNull()), "v")
                 .select(*key, "item_idx", F.col("v.rule").alias("rule"), F.col("v.detail").alias("detail")))


def record_violations(df: DataFrame, key: list[str], args: str = "args", max_args: int = 4) -> DataFrame:
    """FLT-7 (gold records): more than ``max_args`` arguments."""
    return (df.where(F.size(args) > max_args)
              .select(*key, F.lit("too_many_args").alias("rule"), F.array_join(args, "\t").alias("detail")))


def resume_split(todo: DataFrame, done: DataFrame, key: str = "sent",
                 pos: str = "line_no") -> tuple[DataFrame, DataFrame]:
    """JON-3: ``(reused, pending)``. Stored rows are matched by key; when the
    store holds a key twice the last stored row wins (``max_by`` on position)."""
    value_cols = [c for c in done.columns if c not in (key, pos)]
    last = done.groupBy(key).agg(*[F.max_by(c, pos).alias(c) for c in value_cols])
    reused = todo.select(key, *[c for c in todo.columns if c != key and c not in value_cols]) \
                 .join(last, key, "inner")
    pending = todo.join(last.select(key), key, "left_anti")
    return reused, pending


def seeded_split(df: DataFrame, key: Column, weights: tuple[int, ...] = (1, 2),
                 seed: int = K.SPLIT_SEED, out: str = "bucket") -> DataFrame:
    """SPL-1: stable seeded split. Bucket = md5 of ``seed:key`` modulo the
    weight total, mapped onto the weights (1:2 -> bucket 0 for one third).
    Unlike ``randomSplit`` it does not change under repartitioning."""
    total = sum(weights)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint") % total
    expr, lo = None, 0
    for b, w in enumerate(weights):
        cond = (h >= lo) & (h < lo + w)
        expr = F.when(cond, F.lit(b)) if expr is None else expr.when(cond, F.lit(b))
        lo += w
    return df.withColumn(out, expr.cast("int"))


def subset(df: DataFrame, name: str, column: str = "subset") -> DataFrame:
    """SPL-2: route a subset name to its rows (a filter on a partition column
    prunes files when the corpus is written ``partitionBy(column)``)."""
    return df.where(F.col(column) == name)
