"""Gaps between consecutive rows and their statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegap.functions.timestamps import t_ms


def with_t_ms(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Add ``t_ms``; rows without a timestamp are left out (see ``undated``)."""
    return df.where(F.col(ts).isNotNull()).withColumn("t_ms", t_ms(ts))


def undated(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The quarantine: rows whose timestamp could not be resolved."""
    return df.where(F.col(ts).isNull())


def ordered(keys: Sequence[str], id_col: str) -> Window:
    return Window.partitionBy(*keys).orderBy("t_ms", id_col)


def gaps(df: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """``sep_ms`` to the row before; it sits on the row that may start a session."""
    return df.withColumn("sep_ms", F.col("t_ms") - F.lag("t_ms").over(ordered(keys, id_col)))


def gap_stats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of the gaps, and the automatic threshold."""
    mean, dev = F.avg("sep_ms"), F.stddev_pop("sep_ms")
    return df.groupBy(*keys).agg(
        F.count("sep_ms").alias("n_gaps"),
        mean.alias("avg_ms"),
        dev.alias("stdev_ms"),
        (mean + 2 * dev).alias("threshold_ms"),
    )


def exceeds_auto(x: Column, n: Column, s: Column, q: Column) -> Column:
    """x > mean + 2 sigma in integers: n gaps with sum s and sum of squares q.

    Exact as long as |n x - s| < 3e18 and n q < 2e37; a decimal overflow falls back
    to doubles.
    """
    d = "decimal(38,0)"
    dev = n.cast("decimal(12,0)") * x.cast("decimal(16,0)") - s.cast(d)
    var = n.cast("decimal(12,0)") * q.cast("decimal(26,0)") - s.cast("decimal(19,0)") * s.cast("decimal(19,0)")
    exact = (dev > 0) & (F.try_multiply(dev.cast("decimal(19,0)"), dev.cast("decimal(19,0)")) > F.try_multiply(F.lit(4).cast("decimal(1,0)"), var.cast("decimal(37,0)")))
    mean = s.cast("double") / n
    rough = x > mean + 2 * F.sqrt(F.greatest(q.cast("double") / n - mean * mean, F.lit(0.0)))
    return F.coalesce(exact, rough)
