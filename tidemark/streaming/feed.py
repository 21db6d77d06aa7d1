"""Arrival-ordered file feeds, to run a stored log through a stream job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path


def write_feed(lines: DataFrame, slice_col: str, folder: str, rows_per_file: int = 1_000_000) -> int:
    """Append ``value`` lines slice by slice; returns the number of files of a slice.

    The slices are those found in the data, in ascending order, a null slice
    first. Every slice gets the same number of files, empty ones included, and a
    file stream takes older files first, so with that many files per trigger each
    slice becomes one micro-batch. Raises if not every row has been written.

    The rows are laid out by slice once; each slice is then read by itself.
    """
    spark = lines.sparkSession
    staged = scratch_path(spark, "feed-slices")
    rows = lines.select(F.col(slice_col).cast("string").alias("slice"), "value", F.lit(1).alias("one"))
    rows.write.partitionBy("slice").parquet(staged)
    sizes = lines.groupBy(slice_col).count().orderBy(F.col(slice_col).asc_nulls_first()).collect()
    files = max([1, *(-(-r["count"] // rows_per_file) for r in sizes)])
    staged_rows = spark.read.schema("value STRING, one INT, slice STRING").parquet(staged) if sizes else None
    for row in sizes:
        own = F.col("slice").eqNullSafe(None if row[0] is None else str(row[0]))
        part = staged_rows.where(own).select("value")
        before = len(_files(spark, folder))
        part.repartition(min(files, row["count"])).write.mode("append").text(folder)
        _pad(spark, folder, files - (len(_files(spark, folder)) - before))
    written, given = (spark.read.text(folder).count() if sizes else 0), sum(r["count"] for r in sizes)
    if written != given:
        raise ValueError(f"{written} of {given} rows written; do values hold line breaks?")
    return files


def _files(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a folder, which may not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else []
    return [f.getPath().getName() for f in found if f.getPath().getName()[0] not in "._"]


def _pad(spark: SparkSession, folder: str, count: int) -> None:
    """Adds ``count`` empty files."""
    for name in (scratch_path(spark, "empty").rpartition("/")[2] for _ in range(count)):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder, f"part-{name}.txt")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path).close()
