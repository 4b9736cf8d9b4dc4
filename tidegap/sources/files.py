"""File, table and text sources."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegap.functions.exif import get_tag, metadata
from tidegap.functions.paths import basename, is_media, mime_of
from tidegap.functions.timestamps import parse_exif, resolve_timestamp
from tidegap.params import Params


def scan(spark: SparkSession, paths: str | list[str], glob: str | None = None, recursive: bool = False, content: bool = True) -> DataFrame:
    """path, name, mime, modificationTime, length and, if wanted, content (read whole, only if used)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(paths)
    name = basename(F.col("path"))
    return files.select("path", name.alias("name"), mime_of(name).alias("mime"), "modificationTime", "length", *(["content"] if content else []))


def with_heads(files: DataFrame, size: int) -> DataFrame:
    """``files`` with the first ``size`` bytes of each as ``content``; null if a file can't be read.

    Spark lists the files; executors then open them by their URI, on any file system that
    pyarrow knows (local, HDFS, S3, GCS), and read no more than the head.
    """
    names = files.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        def head(path: str) -> bytes | None:
            try:
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_stream(inner, buffer_size=0) as f:
                    return f.read(size)
            except OSError:
                return None

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                data = pa.array(map(head, part.column(names.index("path")).to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, data], [*names, "content"])

    return files.mapInArrow(run, T.StructType([*files.schema, T.StructField("content", T.BinaryType())]))


def scan_directory(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """``*.JPG`` of one directory; whole contents are read only on demand."""
    return scan(spark, path, glob="*.JPG", content=content)


def scan_tree(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """JPG files of a tree, in either case; whole contents are read only on demand."""
    return scan(spark, path, glob="*.[jJ][pP][gG]", recursive=True, content=content)


def find_image(files: DataFrame, name: str) -> DataFrame:
    """Bytes of the file with this base name."""
    return files.where(F.col("name") == name).select("content")


def photos(files: DataFrame, params: Params = Params(), tag: str = "DateTime", videos: bool = True) -> DataFrame:
    """id, url and create_date of every kept file. The type filter precedes reading and
    only the first bytes of a file reach the decoder; no more is read of files that were
    scanned without their content."""
    meta = _decoded(files.where(is_media(F.col("mime"), params.include_all, videos)), params)
    when = resolve_timestamp(get_tag(F.col("_m.exif"), tag), F.col("name"), F.col("modificationTime"))
    return meta.select(F.col("path").alias("id"), F.col("path").alias("url"), when.alias("create_date"))


def photos_with_exif(files: DataFrame, params: Params = Params()) -> DataFrame:
    """file and exif; files without any metadata are left out."""
    return _decoded(files, params).where(F.size("_m.exif") > 0).select(F.col("path").alias("file"), F.col("_m.exif").alias("exif"))


def _decoded(files: DataFrame, params: Params) -> DataFrame:
    """``files`` with the metadata of their heads, ``_m``."""
    heads = files if "content" in files.columns else with_heads(files, params.exif_prefix)
    return heads.withColumn("_m", metadata(F.substring("content", 1, params.exif_prefix)))


def read_dates(spark: SparkSession, path: str) -> DataFrame:
    """A headerless file of EXIF-style timestamps: raw, ts."""
    raw = spark.read.schema("raw string").csv(path)
    return raw.withColumn("ts", parse_exif(F.col("raw")))


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """CSV of ``MMM yyyy`` dates and prices: date, price."""
    raw = spark.read.schema("date string, price string").option("header", True).csv(path)
    day = F.try_to_timestamp("date", F.lit("MMM yyyy")).cast("date")
    return raw.select(day.alias("date"), F.col("price").try_cast("double").alias("price"))


def read_listing(spark: SparkSession, path: str, tag: str = "CreateDate") -> DataFrame:
    """A JSON listing of files with tag maps: file, ts. Rows without a date are left out."""
    raw = spark.read.schema("file string, exif map<string,string>").option("multiLine", True).json(path)
    ts = parse_exif(F.try_element_at("exif", F.lit(tag)))
    return raw.select("file", ts.alias("ts")).where("ts is not null")


def write_listing(df: DataFrame, path: str) -> None:
    """JSON lines of a listing; an empty listing is an empty folder."""
    df.write.mode("overwrite").json(path)
