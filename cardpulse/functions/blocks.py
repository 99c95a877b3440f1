"""Sums of arrays that tasks return, added in the order of the tasks so that reruns agree to the last bit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Elementwise sums of the array ``S`` per ``keys``, added in the order of the tasks ``P`` that gave them."""
    rows = F.array_sort(F.collect_list(F.struct("P", "S")))     # one row per task
    zero = F.transform(F.get(F.col("_R"), 0)["S"], lambda v: F.lit(0.0))
    return (parts.groupBy(*keys).agg(rows.alias("_R"))
            .select(*keys, F.aggregate("_R", zero, lambda acc, r: F.zip_with(acc, r["S"], lambda a, b: a + b)).alias("S")))
