"""Greedy one-to-one assignment (JON-7) and folds over groups of any size.

Semantics (G1-G4): repeatedly take the best remaining cell whose row and
column are both free; ties go to the lowest row, then the lowest column. This
equals one pass over the cells sorted by (score, row, col) that accepts a cell
when its row and column are free.

``banded_fold`` runs such a pass: a group's items, in their order, are cut
into bands of at most ``fold_cells`` items; one band of every group is folded
in a row (``aggregate``), and the state goes on to the next band through a
written table. A group with few items is one band. The number of rounds is
that of bands in the largest group, whatever the items hold.

Large groups first go through rounds of *locally dominant* cells: a cell that
is first of all remaining cells of its row and of its column belongs to the
matching, so all of them are accepted at once, spread over ``(key, row)`` and
``(key, col)``. As soon as a round takes away less than half of the cells (a
long chain of dependent cells), the rest is folded in bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespark.functions.arrays import explode_rows
from tuplespark.operators.indexing import with_index
from tuplespark.session import materialize

FOLD_CELLS = 20000


def _fold(items: DataFrame, key: list[str], fields: list[str], step: str, start: DataFrame) -> DataFrame:
    """One ``aggregate`` per group over its items sorted by ``fields``."""
    listed = items.groupBy(*key).agg(F.expr(f"array_sort(collect_list(struct({', '.join(fields)})))").alias("__items"))
    return listed.join(start, key).select(*key, F.expr(f"aggregate(__items, state, (acc, x) -> {step})").alias("state"))


def banded_fold(items: DataFrame, key: list[str], fields: list[str], step: str, start: DataFrame,
                fold_cells: int = FOLD_CELLS) -> DataFrame:
    """``(key.., state)`` after folding each group's items in the order of
    ``fields``: ``step`` is SQL text over ``acc`` (the state so far) and ``x``
    (an item). ``start`` holds ``(key.., state)`` for every group. No row ever
    holds more than ``fold_cells`` items. ``items`` should be a written table."""
    sizes = items.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    large = materialize(sizes.where(F.col("__n") > fold_cells))
    if large.isEmpty():
        return _fold(items, key, fields, step, start)
    small = _fold(items.join(large, key, "left_anti"), key, fields, step, start)
    ranked = with_index(items.join(large, key, "left_semi").select(*key, *fields), key + fields, out="__rank")
    lowest = ranked.groupBy(*key).agg(F.min("__rank").alias("__first"))
    bands = materialize(ranked.join(lowest, key).withColumn("__band", F.floor((F.col("__rank") - F.col("__first")) / fold_cells))
                        .select(*key, *fields, "__band"), partition_by=["__band"])
    state = materialize(start.join(large, key).withColumn("__bands", F.ceil(F.col("__n") / fold_cells)).select(*key, "state", "__bands"))
    rounds = state.agg(F.max("__bands")).first()[0]
    done = [small]
    for band in range(rounds):
        folded = _fold(bands.where(F.col("__band") == band), key, fields, step, state.drop("__bands"))
        after = materialize(folded.join(state.drop("state"), key))
        done.append(after.where(F.col("__bands") == band + 1).select(*key, "state"))
        state = after.where(F.col("__bands") > band + 1)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _dominant(cells: DataFrame, key: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """Accepted cells of the rounds that at least halve what is left, and the rest."""
    accepted, left, n = [], cells, cells.count()
    while n:
        first = F.min(F.struct("__o", "__row", "__col")).alias("__best")
        by_row = left.groupBy(*key, "__row").agg(first).select(*key, "__best")
        by_col = left.groupBy(*key, "__col").agg(first).select(*key, "__best")
        taken = materialize(by_row.join(by_col, key + ["__best"]).select(*key, "__best.*"))
        accepted.append(taken)
        left = materialize(left.join(taken.select(*key, "__row"), key + ["__row"], "left_anti")
                           .join(taken.select(*key, "__col"), key + ["__col"], "left_anti"))
        before, n = n, left.count()
        if 2 * n > before:
            break
    return accepted, left


def greedy_match(cells: DataFrame, key: list[str] | str, row: str, col: str, score: str,
                 higher: bool = True, fold_cells: int = FOLD_CELLS) -> DataFrame:
    """Accepted cells ``(key.., row, col, score)`` of the greedy assignment.

    ``cells`` holds one row per non-NULL cell; ``(key, row, col)`` is unique.
    """
    key = [key] if isinstance(key, str) else list(key)
    sign = -1.0 if higher else 1.0
    base = cells.select(*key, (F.col(score).cast("double") * sign).alias("__o"), F.col(row).cast("bigint").alias("__row"),
                        F.col(col).cast("bigint").alias("__col"))
    step = ("CASE WHEN array_contains(acc.rows, x.__row) OR array_contains(acc.cols, x.__col) THEN acc ELSE "
            "named_struct('rows', array_append(acc.rows, x.__row), 'cols', array_append(acc.cols, x.__col), "
            "'picked', array_append(acc.picked, x)) END")
    none = F.expr("named_struct('rows', CAST(array() AS ARRAY<BIGINT>), 'cols', CAST(array() AS ARRAY<BIGINT>), "
                  "'picked', CAST(array() AS ARRAY<STRUCT<__o: DOUBLE, __row: BIGINT, __col: BIGINT>>)) AS state")
    large = materialize(base.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > fold_cells))
    accepted: list[DataFrame] = []
    if not large.isEmpty():
        accepted, left = _dominant(materialize(base.join(large, key, "left_semi")), key)
        base = base.join(large, key, "left_anti").unionByName(left)
    folded = banded_fold(base, key, ["__o", "__row", "__col"], step, base.select(*key).distinct().select(*key, none), fold_cells)
    out = explode_rows(folded, key, "state.picked", "m").select(*key, "m.*")
    for a in accepted:
        out = out.unionByName(a)
    return out.select(*key, F.col("__row").alias(row), F.col("__col").alias(col), (F.col("__o") * sign).alias(score))
