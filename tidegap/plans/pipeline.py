"""From files or events to named albums in one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegap.operators.gaps import gap_stats, gaps, with_t_ms
from tidegap.operators.naming import with_names
from tidegap.operators.sessions import assign_any, summarise
from tidegap.params import Params, to_unit
from tidegap.sources.files import photos


def albums(rows: DataFrame, keys: Sequence[str], id_col: str, ts: str = "ts", params: Params = Params()) -> DataFrame:
    """Named albums of timestamped rows."""
    return with_names(summarise(assign_any(with_t_ms(rows, ts), keys, id_col, params), keys, id_col), params)


def photo_albums(files: DataFrame, params: Params = Params()) -> DataFrame:
    """Named albums of scanned files, each directory being a timeline."""
    from tidegap.functions.paths import dirname

    rows = photos(files, params).withColumn("folder", dirname(F.col("url")))
    return albums(rows, ["folder"], "id", "create_date", params)


def summary(rows: DataFrame, keys: Sequence[str], id_col: str, ts: str = "ts", params: Params = Params()) -> DataFrame:
    """Mean, deviation and the threshold in force, in the chosen unit."""
    stats = gap_stats(gaps(with_t_ms(rows, ts), keys, id_col), keys)
    limit = F.col("threshold_ms") if params.auto else F.lit(float(params.threshold_ms))
    shown = {"avg": F.col("avg_ms"), "stdev": F.col("stdev_ms"), "separation": limit}
    return stats.select(*keys, "n_gaps", *[to_unit(c, params.unit, params.unit_compat).alias(k) for k, c in shown.items()])
