"""Timelines whose keys, or whose single key, hold more rows than a task should sort.

Rows are ranged by key and order, and each row's range number is written with it, so that
every later step sees the same ranges. Inside a range windows work as usual; only keys that
span ranges need more, and of these there are two a range at most. Their pieces are a
table of bounded size that carries times and counts from range to range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegap.storage import durable


class Ranges:
    """``rows`` with the range number ``_p``, and the window over a key's piece in a range."""

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None):
        n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.keys, self.order = list(keys), list(order)
        ranged = df.repartitionByRange(n, *self.keys, *self.order).withColumn("_p", F.spark_partition_id())
        self.rows = durable(ranged, "ranges")
        self.piece = Window.partitionBy("_p", *self.keys)
        self.inside = self.piece.orderBy(*self.order)
        #: The pieces of a spanning key, in order.
        self.along = Window.partitionBy(*self.names).orderBy("_at")
        one = self.rows.groupBy("_p", *self.keys).count()
        many = F.count("*").over(Window.partitionBy(*self.keys)) > 1
        self.spans = durable(one.withColumn("_many", many).where("_many").select(self._named()), "spans")

    @property
    def names(self) -> list[str]:
        return [f"_k{i}" for i in range(len(self.keys))]

    def _named(self) -> list[Column]:
        return [F.col("_p").alias("_at"), *[F.col(k).alias(n) for k, n in zip(self.keys, self.names)]]

    def _same(self, place: bool) -> Column:
        on = F.col("_p") == F.col("_at") if place else F.lit(True)
        for k, n in zip(self.keys, self.names):
            on = on & F.col(k).eqNullSafe(F.col(n))
        return on

    def spanning(self, df: DataFrame) -> DataFrame:
        """The rows of spanning keys."""
        return df.join(F.broadcast(self.spans), self._same(True), "left_semi")

    def pieces(self, df: DataFrame, **sums: Column) -> DataFrame:
        """Aggregates of each piece of a spanning key: two rows a range at most."""
        return self.spanning(df).groupBy("_p", *self.keys).agg(*[c.alias(n) for n, c in sums.items()]).select(*self._named(), *sums)

    def totals(self, df: DataFrame, **sums: Column) -> DataFrame:
        """Aggregates of each spanning key: one row a range at most."""
        rows = self.spanning(df).groupBy(*self.keys).agg(F.count("*").alias("_any"), *[c.alias(n) for n, c in sums.items()])
        return rows.where("_any > 0").select(*[F.col(k).alias(n) for k, n in zip(self.keys, self.names)], *sums)

    def carry(self, df: DataFrame, table: DataFrame, place: bool = True) -> DataFrame:
        """df with the columns of ``pieces`` or (without ``place``) ``totals``; null for other keys."""
        joined = df.join(F.broadcast(table), self._same(place), "left")
        return joined.drop("_at", *self.names)


def with_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Add ``_i``, the zero-based place of a row in its key, and ``_n``, the key's rows,
    without sorting a key in one task."""
    ranges = Ranges(df, keys, order, partitions)
    table = ranges.pieces(ranges.rows, _c=F.count("*"))
    whole = Window.partitionBy(*ranges.names)
    table = table.select("_at", *ranges.names, (F.sum("_c").over(ranges.along) - F.col("_c")).alias("_b"), F.sum("_c").over(whole).alias("_t"))
    rows = ranges.rows.withColumn("_i", F.row_number().over(ranges.inside) - 1).withColumn("_n", F.count("*").over(ranges.piece))
    rows = ranges.carry(rows, table)
    return rows.withColumn("_i", F.col("_i") + F.coalesce("_b", F.lit(0))).withColumn("_n", F.coalesce("_t", "_n")).drop("_b", "_t", "_p")
