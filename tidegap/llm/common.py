"""What several operators share: names, batches of bounded size and word splitting."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegap.storage import clean, discard, durable, shared_dir  # noqa: F401

if TYPE_CHECKING:
    import pyarrow as pa

#: A word: a run of anything but space, tab, newline, vertical tab, form feed, return.
WORD = "[^\\x20\\x09-\\x0D]+"


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, led by underscores until none of ``taken`` is it in any case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def columns(names: Sequence[str]) -> list[Column]:
    """Columns by their exact names, dots and back-ticks included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def plain(df: DataFrame) -> DataFrame:
    """df with column names c0, c1, ...: Arrow functions don't take names with dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 4 << 20) -> None:
    """Let Arrow batches hold ``rows`` rows and about ``size`` bytes at most, as the memory
    of workers follows them. Smaller settings of the session stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(re.sub(r"[^\d-]", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, most)


def trim() -> None:
    """Give freed memory back at the end of a task; workers live on between tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run, after: Callable[[], None] | None = None):
    """``run`` (for mapInArrow) with ``after`` and ``trim`` at its end."""

    def wrapped(batches):
        yield from run(batches)
        if after:
            after()
        trim()

    return wrapped


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes: bytes.split() knows exactly the six separators of WORD."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def byte_groups(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about ``limit`` bytes, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = room = 0
    for i, n in enumerate(sizes):
        if room and room + n > limit:
            yield start, i
            start, room = i, 0
        room += n
    if start < len(sizes):
        yield start, len(sizes)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
