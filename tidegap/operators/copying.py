"""Copy or move plans for albums, and carrying them out."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegap.functions.paths import basename, dirname, join_path


def default_output(files: DataFrame, url: str = "url", id_col: str = "id") -> DataFrame:
    """The directory of the first file."""
    return files.agg(dirname(F.min_by(url, id_col)).alias("output"))


def manifest(photos: DataFrame, output: str, url: str = "url", album: str = "name", move: bool = False) -> DataFrame:
    """source, destination, action and ``conflict``: rows of a destination after its first."""
    dest = join_path(F.lit(output), F.col(album), basename(F.col(url)))
    return _planned(photos, F.col(url), dest, "move" if move else "copy")


def flatten_manifest(files: DataFrame, url: str = "url", output: str | None = None) -> DataFrame:
    """Moves every file of a tree into one directory, the working one unless ``output`` is given."""
    name = basename(F.col(url))
    return _planned(files, F.col(url), name if output is None else join_path(F.lit(output), name), "move")


def _planned(files: DataFrame, source: Column, dest: Column, action: str) -> DataFrame:
    out = files.select(source.alias("source"), dest.alias("dest"), F.lit(action).alias("action"))
    turn = F.row_number().over(Window.partitionBy("dest").orderBy("source"))
    return out.withColumn("conflict", turn > 1)


def execute(plan: DataFrame, dry_run: bool = True) -> DataFrame:
    """Carry out a manifest on executors that share its file system; status per row.

    A repeated copy writes the same bytes and a repeated move of a file that already
    arrived is reported as done, so retried tasks are harmless. Conflicts and
    failures are rows, not exceptions.
    """

    def run(batches: Iterator) -> Iterator:
        import os
        import shutil
        import uuid

        for pdf in batches:
            status = []
            for row in pdf.itertuples():
                try:
                    if row.conflict:
                        status.append("conflict")
                    elif dry_run:
                        status.append("planned")
                    elif row.action == "move" and not os.path.exists(row.source) and os.path.exists(row.dest):
                        status.append("done")
                    else:
                        os.makedirs(os.path.dirname(row.dest) or ".", exist_ok=True)
                        part = f"{row.dest}.{uuid.uuid4().hex}.part"  # a task may run twice at once
                        shutil.copy2(row.source, part)
                        os.replace(part, row.dest)
                        if row.action == "move":
                            os.remove(row.source)
                        status.append("done")
                except OSError as e:
                    status.append(f"failed: {e.strerror}")
            yield pdf[["source", "dest", "action"]].assign(status=status)

    return plan.mapInPandas(run, "source string, dest string, action string, status string")


def progress(results: DataFrame) -> DataFrame:
    """Successful rows of all rows."""
    return results.agg(F.count_if(F.col("status") == "done").alias("n_done"), F.count("*").alias("n_total"))
