"""Timeline geometry: scales, points, regions and colours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the chart: width, height and margins in pixels.
WIDTH, WEB_WIDTH, HEIGHT = 760, 960, 80
MARGIN = {"left": 50, "right": 50, "top": 20, "bottom": 20}
COLORS = 20


def time_scale(t: Column, lo: Column, hi: Column, width: float) -> Column:
    """Linear from [lo, hi] to [0, width]; 0 when the domain has no width."""
    return F.coalesce(F.try_divide((t - lo).cast("double"), (hi - lo).cast("double")) * F.lit(float(width)), F.lit(0.0))


def value_scale(v: Column, top: Column, height: float) -> Column:
    """Linear from [0, top] to [height, 0]."""
    return F.lit(float(height)) * (1 - F.coalesce(F.try_divide(v.cast("double"), top.cast("double")), F.lit(0.0)))


def inner_width(width: int = WIDTH, web: bool = False) -> int:
    return WEB_WIDTH if web else width - MARGIN["left"] - MARGIN["right"]


def extent(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi"))


def _whole(df: DataFrame, keys: Sequence[str], **sums: Column) -> DataFrame:
    """df with aggregates of each row's key. They are combined before the shuffle and joined,
    so that a key with most rows is split, which a window over it would not be."""
    names = [f"_k{i}" for i in range(len(keys))]
    table = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(*[c.alias(n) for n, c in sums.items()])
    if not keys:
        return df.crossJoin(F.broadcast(table))  # exactly one row
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    return df.join(table, on).drop(*names)


def points(df: DataFrame, keys: Sequence[str], width: float | None = None) -> DataFrame:
    """x, y and radius of each row on its key's timeline."""
    rows = _whole(df, keys, _lo=F.min("t_ms"), _hi=F.max("t_ms"))
    x = time_scale(F.col("t_ms"), F.col("_lo"), F.col("_hi"), width or inner_width())
    return rows.withColumn("x", x).withColumn("y", F.lit(10)).withColumn("r", F.lit(2)).drop("_lo", "_hi")


def regions(albums: DataFrame, keys: Sequence[str], width: float | None = None) -> DataFrame:
    """x, width and height of each album's rectangle."""
    w, size = Window.partitionBy(*keys), width or inner_width()
    lo, hi = F.min("start_ms").over(w), F.max("end_ms").over(w)
    left, right = (time_scale(F.col(c), lo, hi, size) for c in ("start_ms", "end_ms"))
    height = HEIGHT - MARGIN["top"] - MARGIN["bottom"]
    return albums.withColumn("x", left).withColumn("width", right - left).withColumn("height", F.lit(height))


def colors(albums: DataFrame, keys: Sequence[str], name: str = "name") -> DataFrame:
    """Ordinal colour 0 to 19 by name, in order of first appearance."""
    first = F.min(F.struct("start_ms", "album_id")).over(Window.partitionBy(*keys, name))
    out = albums.withColumn("_first", first)
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first"))
    return out.withColumn("color", F.pmod(rank - 1, F.lit(COLORS))).drop("_first")


def series(df: DataFrame, x: Column, y: Column, keys: Sequence[str] = (), width: float = 660, height: float = 40, zoom: tuple | None = None) -> DataFrame:
    """Line layout of a series; ``zoom`` narrows the domain without dropping rows."""
    rows = _whole(df, keys, _lo=F.min(x), _hi=F.max(x), _top=F.max(y))
    lo, hi = (F.lit(zoom[0]), F.lit(zoom[1])) if zoom else (F.col("_lo"), F.col("_hi"))
    return rows.withColumn("px", time_scale(x, lo, hi, width)).withColumn("py", value_scale(y, F.col("_top"), height)).drop("_lo", "_hi", "_top")


def progress_arc(done: Column, total: Column) -> Column:
    """End angle in radians of a progress ring."""
    return F.coalesce(2 * F.pi() * F.try_divide(done, total), F.lit(0.0))
