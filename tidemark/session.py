"""Session settings, the shared scratch folder, and size-checked joins."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Lookup tables up to this many values in rows are broadcast; larger ones are
# joined by shuffle (adaptive execution then splits the skewed partitions).
BROADCAST_ROWS = 200_000

# Rows of a task that writes a table of bounded size.
TASK_ROWS = 10_000


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the library relies on; all can be changed on a live session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) may fall back to a temporary folder: on a
    cluster a machine-local folder would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tidemark-")
    warnings.warn(f"spark.checkpoint.dir is not set; tables go to {folder}", stacklevel=2)
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder of this application, which can be dropped when it is over."""
    run = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/tidemark-{run}/{label}-{uuid.uuid4().hex}"


def few_tasks(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, of at most ``most_rows`` rows, in no more tasks and files than these need.

    Executors start processes for each file that they write to a local folder (Hadoop
    sets its permissions), so small tables should not have one for each shuffle partition.
    """
    return df.coalesce(1 + most_rows // TASK_ROWS)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage like a reliable checkpoint, but columnar, so later reads
    prune columns and the planner sees real file sizes.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._scratch_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Deletes tables that ``materialize`` wrote, once all that was made of them is written.

    A table that some lazy result still reads must stay.
    """
    for table in tables:
        path, jvm = getattr(table, "_scratch_path", None), table.sparkSession._jvm
        if path:
            found = jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(found, True)


def materialize_observed(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize``, plus aggregates of the written rows from the same job."""
    observation = Observation()
    table = materialize(df.observe(observation, *metrics), label)
    return table, observation.get


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys``, nulls matching nulls, keeping the left keys."""
    renamed = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_key_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_key_{k}" for k in keys])


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    how: str = "inner",
    right_rows: int | None = None,
    row_width: int = 1,
) -> DataFrame:
    """Join a lookup table with unique ``keys`` onto many rows.

    The table is broadcast only when its counted size allows it. ``right_rows``
    passes a size already known; otherwise the table is written once and counted.
    ``row_width`` is the number of entries of a row that holds a map or array.
    Without keys the table is a single row, attached as constants.
    """
    if not keys:
        values = right.first()
        return left.withColumns(
            {f.name: F.lit(values[f.name]).cast(f.dataType) for f in right.schema.fields}
        )
    if right_rows is None:
        right, counted = materialize_observed(right, "lookup", F.count(F.lit(1)).alias("rows"))
        right_rows = counted["rows"]
    if right_rows * row_width <= BROADCAST_ROWS:
        right = F.broadcast(right)
    return same_keys(left, right, keys, how)
