"""Splitting a timeline where a gap exceeds a threshold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegap.functions.timestamps import ms_to_ts
from tidegap.operators.gaps import exceeds_auto, gaps, ordered
from tidegap.operators.ranged import Ranges
from tidegap.params import Params
from tidegap.storage import durable

#: Rows of a key that a task sorts at once.
ROWS_OF_A_KEY = 5_000_000


def assign(df: DataFrame, keys: Sequence[str], id_col: str, params: Params = Params()) -> DataFrame:
    """Add ``sep_ms`` and a zero-based ``album_id`` per key.

    Gaps, statistics, flags and the running count share one partitioning and one
    sort, so a keyed timeline costs a single shuffle; see ``assign_any`` for large keys.
    """
    out, whole = gaps(df, keys, id_col), Window.partitionBy(*keys)
    sep = F.col("sep_ms")
    if params.auto:
        out = (
            out.withColumn("_n", F.count("sep_ms").over(whole))
            .withColumn("_s", F.sum(sep.cast("decimal(18,0)")).over(whole))
            .withColumn("_q", F.sum(sep.cast("decimal(16,0)") * sep.cast("decimal(16,0)")).over(whole))
        )
        flag = exceeds_auto(sep, F.col("_n"), F.col("_s"), F.col("_q"))
    else:
        flag = sep > F.lit(params.threshold_ms)
    run = ordered(keys, id_col).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("album_id", F.sum(F.coalesce(flag.cast("int"), F.lit(0))).over(run).cast("int"))
    return out.drop("_n", "_s", "_q")


def summarise(df: DataFrame, keys: Sequence[str], id_col: str, url_col: str | None = None) -> DataFrame:
    """One row per album: bounds, count and the first and last photo."""
    url, by = F.col(url_col or id_col), F.struct("t_ms", id_col)
    return (
        df.groupBy(*keys, "album_id")
        .agg(
            F.min("t_ms").alias("start_ms"),
            F.max("t_ms").alias("end_ms"),
            F.count("*").alias("n_photos"),
            F.min_by(url, by).alias("first_photo"),
            F.max_by(url, by).alias("last_photo"),
        )
        .withColumn("start", ms_to_ts(F.col("start_ms")))
        .withColumn("end", ms_to_ts(F.col("end_ms")))
    )


def collect_photos(df: DataFrame, keys: Sequence[str], id_col: str, url_col: str | None = None) -> DataFrame:
    """Albums with their photos nested in time order. An album becomes one row, so
    at scale prefer ``summarise`` and the member rows of ``assign``."""
    item = F.struct(F.col("t_ms"), F.col(id_col).alias("id"), F.col(url_col or id_col).alias("url"))
    return df.groupBy(*keys, "album_id").agg(F.array_sort(F.collect_list(item)).alias("photos"))


def by_session_window(df: DataFrame, keys: Sequence[str], ts: str, gap_ms: int) -> DataFrame:
    """Fixed-gap sessions through the built-in session window (batch or streaming).

    It compares microseconds, hence the truncation; its own end is last + gap.
    """
    ms = F.date_trunc("MILLISECOND", F.col(ts)).cast("timestamp_ntz")
    out = df.withColumn("_ts", ms).groupBy(*keys, F.session_window("_ts", f"{gap_ms} milliseconds"))
    return out.agg(F.min("_ts").alias("start"), F.max("_ts").alias("end"), F.count("*").alias("n_photos")).drop("session_window")


def assign_ranged(df: DataFrame, keys: Sequence[str], id_col: str, params: Params = Params(), partitions: int | None = None) -> DataFrame:
    """``assign`` without sorting or counting a key in one task, whatever its share of rows.

    Lag and running counts stay inside a range of rows; the last time, the sums and the
    split count of keys that span ranges are carried across. The rows are written once, in
    the shared folder. Columns whose names begin with an underscore and one of the letters
    used here may not be among those of ``df``.
    """
    ranges = Ranges(df, keys, ["t_ms", id_col], partitions)
    sep, square = F.col("sep_ms"), F.col("sep_ms").cast("decimal(16,0)") * F.col("sep_ms").cast("decimal(16,0)")
    ends = ranges.pieces(ranges.rows, _lo=F.min("t_ms"), _hi=F.max("t_ms"))
    heads = ends.withColumn("_head", F.col("_lo") - F.lag("_hi").over(ranges.along)).drop("_lo", "_hi")

    def gapped(rows: DataFrame) -> DataFrame:
        first = F.row_number().over(ranges.inside) == 1
        lag = F.col("t_ms") - F.lag("t_ms").over(ranges.inside)
        return ranges.carry(rows.withColumn("_first", first).withColumn("sep_ms", lag), heads).withColumn("sep_ms", F.when(F.col("_first"), F.col("_head")).otherwise(sep)).drop("_first", "_head")

    def flagged(rows: DataFrame) -> DataFrame:
        if params.auto:
            sums = {"n": F.count(sep), "s": F.sum(sep.cast("decimal(18,0)")), "q": F.sum(square)}
            out = rows.withColumns({f"_{k}": c.over(ranges.piece) for k, c in sums.items()})
            out = ranges.carry(out, totals, place=False)
            flag = exceeds_auto(sep, *[F.coalesce(f"_t{k}", f"_{k}") for k in sums])
        else:
            out, flag = rows, sep > F.lit(params.threshold_ms)
        return out.withColumn("_f", F.coalesce(flag.cast("int"), F.lit(0))).drop("_n", "_s", "_q", "_tn", "_ts", "_tq")

    spanning = gapped(ranges.spanning(ranges.rows))
    if params.auto:
        totals = durable(ranges.totals(spanning, _tn=F.count(sep), _ts=F.sum(sep.cast("decimal(18,0)")), _tq=F.sum(square)), "totals")
    before = ranges.pieces(flagged(spanning), _c=F.sum("_f"))
    before = durable(before.withColumn("_b", F.sum("_c").over(ranges.along) - F.col("_c")).drop("_c"), "before")
    run = ranges.inside.rowsBetween(Window.unboundedPreceding, 0)
    out = ranges.carry(flagged(gapped(ranges.rows)).withColumn("_r", F.sum("_f").over(run)), before)
    out = out.withColumn("album_id", (F.col("_r") + F.coalesce("_b", F.lit(0))).cast("int"))
    return out.drop("_p", "_f", "_r", "_b")


def assign_global(df: DataFrame, id_col: str, params: Params = Params(), partitions: int | None = None) -> DataFrame:
    """``assign`` for one timeline without a key."""
    return assign_ranged(df, [], id_col, params, partitions)


def assign_any(df: DataFrame, keys: Sequence[str], id_col: str, params: Params = Params(), most: int = ROWS_OF_A_KEY) -> DataFrame:
    """``assign`` if no key has more than ``most`` rows, ``assign_ranged`` otherwise."""
    largest = df.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0
    return (assign if largest <= most else assign_ranged)(df, keys, id_col, params)
