"""Micro-batch segmentation.

An automatic threshold depends on every gap so far: a late row may re-split all
history, so each micro-batch is stored and the result computed anew from the store.
A fixed gap needs no recomputation: ``fixed_gap`` is a session window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidegap.operators.gaps import with_t_ms
from tidegap.operators.sessions import assign, summarise
from tidegap.params import Params


def albums_of(rows: DataFrame, keys: Sequence[str], id_col: str, ts: str, params: Params) -> DataFrame:
    return summarise(assign(with_t_ms(rows, ts), keys, id_col, params), keys, id_col)


def start_recompute(stream: DataFrame, keys: Sequence[str], id_col: str, ts: str, store: str, checkpoint: str, publish: Callable[[DataFrame, int], None], params: Params = Params()) -> StreamingQuery:
    """Start a query that stores each micro-batch under its number (so a retry
    overwrites itself) and publishes the albums of all rows stored so far."""
    spark, part = stream.sparkSession, "_batch"
    stored = T.StructType([*stream.schema, T.StructField(part, T.LongType())])

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/{part}={number}")
        # a batch that failed before may lie there already, so only numbers up to this one count
        rows = spark.read.schema(stored).parquet(store).where(F.col(part) <= number).drop(part)
        publish(albums_of(rows, keys, id_col, ts, params), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 50) -> DataFrame:
    """Parquet files of a folder, at most ``files_per_batch`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def fixed_gap(stream: DataFrame, keys: Sequence[str], ts: str, gap_ms: int, lateness: str) -> DataFrame:
    """Sessions of a stream under a fixed gap; closed ones leave in append mode."""
    marked = stream.withColumn("_ts", F.date_trunc("MILLISECOND", F.col(ts))).withWatermark("_ts", lateness)
    out = marked.groupBy(*keys, F.session_window("_ts", f"{gap_ms} milliseconds"))
    return out.agg(F.min("_ts").alias("start"), F.max("_ts").alias("end"), F.count("*").alias("n_photos")).drop("session_window")
