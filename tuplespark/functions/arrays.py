"""Array -> rows without re-evaluating the array.

``posexplode(expr)`` lets Catalyst infer ``size(expr) > 0`` below the
generator and push it through the projection that computes ``expr``, so an
expensive array expression (a parse, a fold) would run two or three times.
The outer generator gets no inferred filter; empty arrays are removed after
it by the position column instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, array: Column | str, value: str,
                 pos: str | None = None) -> DataFrame:
    """``keep`` columns plus one row per element (``value``), with its 0-based
    position in ``pos`` when given. Empty or NULL arrays give no row."""
    p = pos or "__pos"
    out = df.select(*keep, F.posexplode_outer(array).alias(p, value)).where(F.col(p).isNotNull())
    return out if pos else out.drop(p)
