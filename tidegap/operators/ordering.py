"""Batches and the progressive processing order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegap.operators.ranged import with_index


def progressive_order(n: int) -> list[int]:
    """A permutation of range(n) that reaches the ends and the middle first.

    Each interval gives its first, last and middle index, then its two remaining
    halves are visited in the same way, left before right.
    """
    out: list[int] = []
    todo = [(0, n)]
    while todo:
        lo, hi = todo.pop()
        size = hi - lo
        if size < 3:
            out.extend(range(lo, hi))
            continue
        mid = lo + size // 2
        out += [lo, hi - 1, mid]
        todo += [(mid + 1, hi - 1), (lo + 1, mid)]
    return out


def priority_of(i: Column, n: Column) -> Column:
    """The place of index i of n in ``progressive_order(n)``: a descent into the half that
    holds i, in about log2(n) steps of built-in functions."""
    start = F.struct(i.cast("long").alias("i"), n.cast("long").alias("n"), F.lit(0).cast("long").alias("base"))
    ended = F.lit(-1).cast("long")

    def step(at: Column, _: Column) -> Column:
        i, n, base = at["i"], at["n"], at["base"]
        mid = F.floor(n / 2)
        here = F.when((n < 3) | (i == 0), base + i).when(i == n - 1, base + 1).when(i == mid, base + 2)
        lower = i < mid
        to = F.struct(
            F.when(here.isNotNull(), ended).when(lower, i - 1).otherwise(i - mid - 1).alias("i"),
            F.when(lower, mid - 1).otherwise(n - mid - 2).alias("n"),
            F.when(here.isNotNull(), here).when(lower, base + 3).otherwise(base + mid + 2).alias("base"),
        )
        return F.when(i == ended, at).otherwise(to)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1))).cast("int"))
    return F.aggregate(steps, start, step, lambda at: at["base"].cast("int"))


def _indexed(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranged: bool) -> DataFrame:
    if ranged:
        return with_index(df, keys, order)
    w = Window.partitionBy(*keys)
    return df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))


def progressive_priority(df: DataFrame, keys: Sequence[str], order: Sequence[str], ranged: bool = False) -> DataFrame:
    """Add ``priority`` per key; ``ranged`` for keys that a task shouldn't sort at once."""
    rows = _indexed(df, keys, order, ranged)
    return rows.withColumn("priority", priority_of(F.col("_i"), F.col("_n"))).drop("_i", "_n")


def chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int = 50, ranged: bool = False) -> DataFrame:
    """Add a zero-based ``batch`` of ``size`` rows per key; ``ranged`` for keys that a task
    shouldn't sort at once."""
    return _indexed(df, keys, order, ranged).withColumn("batch", F.floor(F.col("_i") / size)).drop("_i", "_n")
