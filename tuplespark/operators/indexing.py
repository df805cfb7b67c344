"""Row numbering, batching and length buckets (WIN-1, WIN-2, ORD-2).

Global numbering never uses a window over all rows. Only the order keys are
range-partitioned and numbered; what else a row carries moves at most once,
when the numbers are joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tuplespark.session import materialize

_LOW_BITS = (1 << 33) - 1   # monotonically_increasing_id: record number bits


def with_index(df: DataFrame, order: list[str], out: str = "idx", partition: list[str] | None = None) -> DataFrame:
    """0-based consecutive index by the columns ``order`` (nulls first).

    With ``partition``: numbering restarts per group (a partitioned window).
    Without: distinct keys are counted (map-side first), range-partitioned,
    sorted and written once with their place in the partition; the partitions'
    sizes, one row each, give the offsets in Spark. The number of partitions
    is the session's, so it follows the size of the keys under AQE. Rows with
    equal keys get neighbouring numbers in no fixed order.
    """
    if partition:
        w = Window.partitionBy(*partition).orderBy(*order)
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
    keys = [f"__k{i}" for i in range(len(order))]
    counted = df.groupBy(*[F.col(c).alias(k) for c, k in zip(order, keys, strict=True)]).agg(F.count(F.lit(1)).alias("__n"))
    # Range bounds come from a sample whose seed changes per execution, so the
    # numbered keys are written once and all later steps read that copy.
    place = F.monotonically_increasing_id()
    ranged = materialize(counted.repartitionByRange(*keys).sortWithinPartitions(*keys)
                         .withColumn("__part", F.shiftright(place, 33)).withColumn("__at", place.bitwiseAND(F.lit(_LOW_BITS))))
    repeats = not ranged.where("__n > 1").isEmpty()
    if repeats:
        inside = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        ranged = ranged.withColumn("__at", F.coalesce(F.sum("__n").over(inside), F.lit(0)))
    # One row per partition, however large the table.
    sizes = ranged.groupBy("__part").agg(F.sum("__n").alias("__size"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__off"))
    first = ranged.join(F.broadcast(offsets), "__part").select(*keys, "__n", (F.col("__off") + F.col("__at")).alias("__first"))
    named = [F.col(k).alias(c) for c, k in zip(order, keys, strict=True)]
    if set(df.columns) == set(order):
        number = F.explode(F.sequence("__first", F.col("__first") + F.col("__n") - 1)) if repeats else F.col("__first")
        return first.select(*named, number.alias(out)).select(*df.columns, out)
    same = [df[c].eqNullSafe(first[k]) for c, k in zip(order, keys, strict=True)]
    joined = df.join(first, same)
    if repeats:
        among = Window.partitionBy(*keys).orderBy(*keys)
        joined = joined.withColumn("__first", F.col("__first") + F.row_number().over(among) - 1)
    return joined.withColumn(out, F.col("__first").cast("bigint")).drop(*keys, "__n", "__first")


def with_batch(df: DataFrame, size: int, idx: str = "idx", out: str = "batch_id") -> DataFrame:
    """WIN-2: fixed-size batches in index order."""
    return df.withColumn(out, F.floor(F.col(idx) / F.lit(size)).cast("bigint"))


def length_buckets(df: DataFrame, size: int, mega: int, length: str = "length",
                   idx: str = "idx", out: str = "batch_id") -> DataFrame:
    """ORD-2: inside each mega-batch of ``size * mega`` rows (index order), sort
    by length descending and cut into batches of ``size``: batches then hold
    similar lengths and need little padding."""
    mega_rows = size * mega
    m = F.floor(F.col(idx) / F.lit(mega_rows))
    w = Window.partitionBy("__mega").orderBy(F.col(length).desc(), F.col(idx))
    return (df.withColumn("__mega", m)
              .withColumn("__rn", F.row_number().over(w) - 1)
              .withColumn(out, (F.col("__mega") * F.lit(mega) + F.floor(F.col("__rn") / F.lit(size))).cast("bigint"))
              .drop("__mega", "__rn"))
