"""Tables written in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where driver and
    executors are one process may it be unset: a temporary folder is then set, which goes
    with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="tidegap-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


_open: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at the end what ``durable`` wrote inside; results must have been saved by then."""
    _open.append([])
    try:
        yield
    finally:
        discard(*_open.pop())


def durable(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a written table in the shared folder: lineage ends there, any executor can
    read it again, and joins on it get exchanges that adaptive execution may split."""
    path = f"{shared_dir(df.sparkSession)}/tidegap/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _open:
        _open[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` wrote and that no result reads."""
    for t in tables:
        delete(t.sparkSession, t.written_at)


def clean(spark: SparkSession) -> None:
    """Delete all that operators left in the shared folder; results that read it must be saved before."""
    delete(spark, f"{shared_dir(spark)}/tidegap")


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
