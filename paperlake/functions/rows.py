"""Rows out of computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, array: Column, value: str, position: str | None = None) -> DataFrame:
    """``df`` with one row per element of ``array``, as column ``value``.

    For a plain explode the optimizer adds ``size(array) > 0`` further down,
    which computes the array a second and third time. An outer explode computes
    it once; the rows of empty arrays are dropped after it.
    """
    index = position or "_index"
    kept = [c for c in df.columns if c not in (index, value)]
    rows = df.select(*kept, F.posexplode_outer(array).alias(index, value)).where(F.col(index).isNotNull())
    return rows if position else rows.drop(index)
