"""Names of albums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegap.functions.timestamps import strftime
from tidegap.params import Params


def with_names(albums: DataFrame, params: Params = Params()) -> DataFrame:
    """``<formatted start>_<prefix>_<n>``, n from 1; needs no new sort or shuffle."""
    number = (F.col("album_id") + 1).cast("string")
    return albums.withColumn("name", F.concat_ws("_", strftime(F.col("start"), params.date_format), F.lit(params.prefix), number))
