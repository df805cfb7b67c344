"""Mixing sources to target weights (operator 4, native expressions only).

Weights are ``share ** alpha`` normalised, with ``share`` a source's part of
all tokens (alpha 1: as found, 0: uniform). ``solve_alpha`` bisects alpha on
the per-source table, 32 exponents per job, until the target is met:

* ``max_repeat``: the most uniform mixture in which no source is repeated more
  often. The budget is the smallest that still takes every source at least
  once, unless ``budget`` fixes the tokens.
* ``entropy``: the mixture whose entropy (nats) has this value.

A source's quota is realised as block permutations: epoch e orders its rows by
an MD5 of (seed, source, epoch, id); the leading hex digits are the block.
Whole epochs take every row. In the last, partial epoch rows are taken in that
order while their running tokens stay within the quota. Running totals are
formed over 4096 block sums per source first, then only inside the block
where the quota ends, so a source with a third of all rows is never sorted in
one task and texts are not shuffled: the order decides row by row.

Tokens are runs of ``[^\\x20\\x09-\\x0D]``. A null source counts as the empty
one; rows without an id are ordered by their text. Rows without tokens take no
budget and go with their neighbours in the order; a source without any token
is taken once. Rows that repeat id and source share their places. Empty table:
no rows. Extra columns pass through ``realise`` when named in ``keep``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tuplespark.llm.common import WORD, small, stored

STEPS = 32
SEED = 17


def source_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  keep: list[str] | None = None) -> DataFrame:
    """``doc_id, source, n_tokens, row_key`` per row (and the kept columns)."""
    carried = [F.struct(*[F.col(c) for c in keep]).alias("carried")] if keep else []
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"),
                     F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
                     F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).alias("row_key"), *carried)


def shares(rows: DataFrame) -> DataFrame:
    """``source, tokens, n_rows``; one row per source."""
    return rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))


def solve_alpha(table: DataFrame, max_repeat: float | None = 2.0, entropy: float | None = None,
                budget: float | None = None, rounds: int = 8) -> float:
    """The exponent, to about ``32 ** -rounds``. The driver sees a few numbers
    per tried exponent, never the sources."""
    t = table.where("tokens > 0")
    total, least, most = t.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not total:
        return 1.0
    p, lo, hi = F.col("tokens") / F.lit(float(total)), 0.0, 1.0
    p_min, p_max = least / total, most / total

    def meets(a: float, z: float, s: float) -> bool:
        """Whether the mixture of exponent ``a`` is still too uniform."""
        if entropy is not None:
            import math
            return math.log(z) - a * s / z > entropy
        repeat = (p_max / p_min) ** (1 - a) if budget is None else budget / total * p_min ** (a - 1) / z
        return repeat > max_repeat

    for _ in range(rounds):
        tries = [lo + (hi - lo) * i / STEPS for i in range(STEPS + 1)]
        got = t.agg(*[e for i, a in enumerate(tries) for e in (
            F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.ln(p)).alias(f"s{i}"))]).first()
        bad = [meets(a, got[f"z{i}"], got[f"s{i}"]) for i, a in enumerate(tries)]
        if not bad[0]:
            return lo
        if all(bad):
            return hi
        last = max(i for i, b in enumerate(bad) if b)
        lo, hi = tries[last], tries[min(last + 1, STEPS)]
    return hi


def quotas(table: DataFrame, alpha: float, budget: float | None = None) -> DataFrame:
    """``source, tokens, weight, quota, epochs, rest``: the whole epochs of a
    source and the tokens of its partial one."""
    t = table.where("tokens > 0")
    total = F.lit(float(t.agg(F.sum("tokens")).first()[0] or 1))
    p = F.col("tokens") / total
    z = float(t.agg(F.sum(F.pow(p, F.lit(alpha)))).first()[0] or 1.0)
    cover = t.agg(F.max(F.col("tokens") / (F.pow(p, F.lit(alpha)) / F.lit(z)))).first()[0] or 0.0
    amount = F.lit(float(cover if budget is None else budget))
    has = F.col("tokens") > 0
    weight = F.when(has, F.pow(p, F.lit(alpha)) / F.lit(z)).otherwise(F.lit(0.0))
    quota = F.round(weight * amount).cast("long")
    out = table.withColumn("weight", weight).withColumn("quota", quota)
    return out.withColumn("epochs", F.when(has, F.expr("quota div tokens")).otherwise(F.lit(1)).cast("int")).withColumn(
        "rest", F.when(has, F.expr("quota % tokens")).otherwise(F.lit(0)).cast("long"))


def _order(epoch):
    return F.md5(F.concat_ws("|", F.lit(str(SEED)), "source", epoch.cast("string"), "row_key"))


def _cut(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, cut``: the last order key that still fits the partial epoch
    ('' where none does)."""
    at = rows.join(plan.where("rest > 0").select("source", "epochs", "rest"), "source").select(
        "source", "n_tokens", "rest", _order(F.col("epochs")).alias("key"))
    at = at.withColumn("block", F.substring("key", 1, 3))
    blocks = at.groupBy("source", "rest", "block").agg(F.sum("n_tokens").alias("n"))
    run = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
    edge = before.where("before <= rest AND before + n > rest").select("source", "block", "before")
    inside = at.join(edge, ["source", "block"])
    per_key = inside.groupBy("source", "rest", "before", "block", "key").agg(F.sum("n_tokens").alias("n"))
    so_far = F.col("before") + F.sum("n").over(Window.partitionBy("source", "block").orderBy("key"))
    fits = per_key.withColumn("upto", so_far).where("upto <= rest").groupBy("source", "block").agg(F.max("key").alias("cut"))
    return edge.join(fits, ["source", "block"], "left").select("source", F.coalesce("cut", "block").alias("cut"))


def realise(rows: DataFrame, plan: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """One row per taken copy: ``doc_id, source, copy, n_tokens, block,
    order_key``. Sorting by ``copy, block, order_key`` gives the permutation.
    ``counted``: the same rows without texts, to find the cuts from."""
    cut = stored(plan.select("source", "epochs", "rest").join(_cut(rows if counted is None else counted, plan), "source", "left"), "mixture-plan")
    met = rows.join(small(cut, F.octet_length("source")), "source")
    copies = met.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("epochs"))))
    copies = copies.withColumn("order_key", _order(F.col("copy")))
    taken = copies.where("copy < epochs OR (rest > 0 AND order_key <= cut)")
    return taken.withColumn("block", F.substring("order_key", 1, 3)).drop("epochs", "rest", "cut", "row_key")


def mix(df: DataFrame, max_repeat: float | None = 2.0, entropy: float | None = None, budget: float | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """The mixed corpus; columns of ``realise`` (kept columns in ``carried``)."""
    rows = source_tokens(df, id_col, text_col, source_col, keep)
    # The count is the only thing that needs the texts; keep it for the passes that follow.
    counted = stored(rows.drop("carried"), "tokens")
    table = stored(shares(counted), "shares")
    plan = quotas(table, solve_alpha(table, max_repeat, entropy, budget), budget)
    return realise(rows if keep else counted, plan, counted)


def digest(df: DataFrame) -> DataFrame:
    return mix(df).select("doc_id", "source", "copy", "n_tokens", "block", "order_key")
