"""Keyed difference of two row sets: enter, update, exit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keyed_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], dedupe: bool = True) -> DataFrame:
    """Full outer join by key with ``change``; a repeated key shows once if ``dedupe``."""
    a, b = old.select(*keys), new.select(*keys)
    if dedupe:
        a, b = a.dropDuplicates(list(keys)), b.dropDuplicates(list(keys))
    joined = a.withColumn("_old", F.lit(True)).join(b.withColumn("_new", F.lit(True)), list(keys), "full_outer")
    change = F.when(F.col("_old").isNull(), "enter").when(F.col("_new").isNull(), "exit").otherwise("update")
    return joined.select(*keys, change.alias("change"))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A zero-based ``pos`` within each key, for differences by index."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
