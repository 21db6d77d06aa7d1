"""Stored run files ``<run>_task-<i>.csv``: discovery, scans and selection.

Trace and window metric files of sliding runs share their run prefix and differ
in a suffix only, so the kind is taken from the whole file name.

Trace lines are stored without quotes, so ``content`` may hold commas: the first
four and the last two fields are fixed, and what is between them is content.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.naming import lag_seconds, run_prefix, task_number
from tidemark.session import lookup_join, materialize_observed, scratch_path
from tidemark.sources import schemas

# File name patterns.
TRACE_FILES = "{*all-data-trace*_task-*.csv,*_task-*_trace.csv,*_task-*_trace.part-*.csv}"
METRIC_FILES = "{*-window_*_task-*.csv,*_task-*_metrics.csv,*_task-*_metrics.part-*.csv}"
RUN_FILES = "*_task-*.csv"

# Tasks that write run files, at most; more parts share them.
MOST_TASKS = 4_000


def _lines(spark: SparkSession, folder: str, pattern: str, layout: str, skip_corrupt: bool) -> DataFrame:
    """The lines of all files but headers and empty lines, with run, lag and task."""
    reader = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", skip_corrupt)
    rows = reader.text(folder).selectExpr("value", "_metadata.file_name as file_name")
    header = ",".join(schemas.names(layout))
    rows = rows.where(f"trim(value) <> '' and trim(value) <> '{header}'")
    return rows.selectExpr(
        f"{run_prefix('file_name')} as run_id",
        f"bigint({lag_seconds('file_name')} * 1000) as lag_ms",
        f"{task_number('file_name')} as file_task",
        "file_name",
        "value",
    )


def _typed(rows: DataFrame, layout: str) -> DataFrame:
    """Typed fields, and ``reason`` for lines that do not fit the layout.

    A line is split once and each field cast once: parts, content and fields come out of
    generators of one row, as the planner copies expressions of a projection into the
    filters and projections above it, but not a generator's.
    """
    fields = [f.split() for f in layout.split(", ")]
    free = schemas.names(layout).index("content") if "content" in layout else None
    size = len(fields)
    casts = {}
    for k, (name, kind) in enumerate(fields):
        if k == free:
            joined = f"array_join(slice(_parts, {k + 1}, size(_parts) - {size - 1}), ',')"
            unquoted = "replace(substr(_free, 2, length(_free) - 2), '\"\"', '\"')"
            text = f"if(_free like '\"%\"' and length(_free) > 1, {unquoted}, _free)"
        else:
            at = k if free is None or k < free else f"size(_parts) - {size - k}"
            text = f"trim(get(_parts, {at}))"
        casts[name] = f"try_cast({text} as {kind})"
    fits = f"size(_parts) >= {size}" if free is not None else f"size(_parts) = {size}"
    numbers = [name for name, kind in fields if kind != "STRING"]
    reason = "case when not _fits then 'number of fields'"
    reason += "".join(f" when {n} is null then 'bad {n}'" for n in numbers)
    if free is not None:
        reason += " when status not in ('NORMAL', 'LATE') then 'bad status'"
    checked = ", ".join(f"if({fits}, {casts[n]}, null) as {n}" for n, _ in fields)
    kept = rows.columns
    rows = rows.selectExpr("*", "explode(array(split(value, ',', -1))) as _parts")
    if free is not None:
        rows = rows.selectExpr("*", f"explode(array(if({fits}, {joined}, null))) as _free")
    rows = rows.selectExpr(*kept, f"inline(array(struct({fits} as _fits, {checked})))")
    return rows.selectExpr(*kept, f"{reason} end as reason", *schemas.names(layout))


def _read(spark: SparkSession, folder: str, pattern: str, layout: str, skip_corrupt: bool) -> DataFrame:
    rows = _typed(_lines(spark, folder, pattern, layout, skip_corrupt), layout)
    return rows.where("reason is null").drop("reason", "value")


def read_traces(spark: SparkSession, folder: str, skip_corrupt: bool = False) -> DataFrame:
    """All trace files of a folder in one scan, with run, lag and file name.

    Lines that do not fit are left out; ``rejects`` lists them. A file that cannot
    be read fails the scan, unless ``skip_corrupt``; ``unread_files`` lists those.
    """
    return _read(spark, folder, TRACE_FILES, schemas.TRACE, skip_corrupt)


def read_metrics(spark: SparkSession, folder: str, skip_corrupt: bool = False) -> DataFrame:
    """All window metric files of a folder in one scan, as ``read_traces``."""
    return _read(spark, folder, METRIC_FILES, schemas.METRICS, skip_corrupt)


def rejects(spark: SparkSession, folder: str, kind: str = "trace", skip_corrupt: bool = False) -> DataFrame:
    """The lines that ``read_traces`` or ``read_metrics`` leaves out, with the reason."""
    pattern, layout = (TRACE_FILES, schemas.TRACE) if kind == "trace" else (METRIC_FILES, schemas.METRICS)
    rows = _typed(_lines(spark, folder, pattern, layout, skip_corrupt), layout)
    return rows.where("reason is not null").select("run_id", "file_name", "value", "reason")


def unread_files(spark: SparkSession, folder: str, kind: str = "trace") -> DataFrame:
    """``file_name`` of the run files from which a scan with ``skip_corrupt`` gets no line."""
    pattern = TRACE_FILES if kind == "trace" else METRIC_FILES
    reader = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", True)
    read = reader.text(folder).selectExpr("_metadata.file_name as file_name").distinct()
    return _listed(spark, folder, pattern).join(read, "file_name", "left_anti")


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.selectExpr("url_decode(element_at(split(path, '/'), -1)) as file_name")


def write_lines(
    rows: DataFrame,
    folder: str,
    header: str,
    rows_per_part: int = 1_000_000,
    group: tuple[str, ...] = ("file",),
    spread: str = "xxhash64(value, monotonically_increasing_id())",
    each: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> None:
    """Writes ``file, value`` lines as plain files named after ``file``, a header in each.

    A file of more than ``rows_per_part`` rows is written in parts ``<file>.part-<k>.csv``
    by as many tasks; readers take the run and task from the part of the name they share.
    The other files have their plain name.

    If many lines are made of a row, pass the rows: ``each`` makes the lines of rows that
    have been moved, counted and cut into parts already, so only rows are shuffled. Files
    of one ``group`` of rows are cut alike, by the hash ``spread``; no two groups may
    share a file. ``each`` has to keep the column ``_part``.
    """
    spark = rows.sparkSession
    staged = scratch_path(spark, "run-lines")
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"))
    sizes = sizes.selectExpr(*group, f"bigint(ceil(n / {rows_per_part}D)) as _parts")
    sizes, found = materialize_observed(sizes, "run-sizes", F.expr("count(1) as groups"), F.expr("coalesce(sum(_parts), 0L) as parts"))
    # Rows are dealt to the parts of their group by a hash, also those of a hot one. The number
    # of tasks is explicit: adaptive execution would merge them by the size of the rows.
    rows = lookup_join(rows, sizes, list(group), right_rows=found["groups"])
    part = f"struct({', '.join(group)}, if(_parts > 1, pmod({spread}, _parts), null) as no) as _part"
    # Twice as many tasks as parts, since a task that gets several sorts them together.
    tasks = max(1, min(2 * found["parts"], MOST_TASKS))
    lines = each(rows.selectExpr("*", part).drop("_parts").repartition(tasks, "_part"))
    lines = lines.selectExpr("if(_part.no is null, file, concat(file, '.part-', _part.no)) as name", "_part", "value")
    # The sort that this window needs is the one by which the writer keeps one file open.
    first = "row_number() over (partition by name, _part order by name) = 1"
    lines = lines.selectExpr("name", f"if({first}, concat('{header}\n', value), value) as value")
    lines.write.partitionBy("name").text(staged)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.Path(staged).getFileSystem(conf)
    files.mkdirs(jvm.org.apache.hadoop.fs.Path(folder))
    for found in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{staged}/name=*/part-*")):
        name = found.getPath().getParent().getName().removeprefix("name=")
        files.rename(found.getPath(), jvm.org.apache.hadoop.fs.Path(folder, f"{unquote(name)}.csv"))


def discover_runs(spark: SparkSession, folder: str, pattern: str = RUN_FILES) -> DataFrame:
    """Distinct run prefixes in a folder, from the file listing alone."""
    names = _listed(spark, folder, pattern)
    return names.selectExpr(f"{run_prefix('file_name')} as run_id").distinct().orderBy("run_id")


def table_kind(rows: DataFrame) -> str:
    """``metrics`` or ``trace``, from the columns present."""
    columns = set(rows.columns)
    if {"trigger_ts", "window_end"} <= columns:
        return "metrics"
    if {"sys_ts", "event_ts", "status"} <= columns:
        return "trace"
    raise ValueError("neither a trace nor a window metric table")


def select_run(rows: DataFrame, run_id: str | None = None) -> DataFrame:
    """One run, or all of them; on partitioned tables this prunes partitions, on run files it prunes files."""
    return rows if run_id is None else rows.where(rows["run_id"] == run_id)
