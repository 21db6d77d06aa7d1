"""Sinks: tables of metrics, traces, series and trade-offs.

All sinks write to a new path and never overwrite what may still be read.
Parquet is the default; CSV writes the stored file layouts, with quoting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.trace import trace_view
from tidemark.operators.windows import Sweep
from tidemark.sources import schemas


def write_table(rows: DataFrame, path: str, run: list[str] | None = None, fmt: str = "parquet") -> None:
    """Write ``rows`` partitioned by the run columns, so one run is one folder.

    A large run is spread over many tasks and files; nothing is gathered.
    """
    writer = rows.write.format(fmt)
    if run:
        writer = writer.partitionBy(*run)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def read_table(spark: SparkSession, path: str, layout: str, run: list[str] | None = None, fmt: str = "csv") -> DataFrame:
    """A table written by one of the sinks, with its run columns as text."""
    schema = ", ".join([layout, *(f"{c} STRING" for c in run or [])])
    return spark.read.format(fmt).schema(schema).option("header", True).load(path)


def write_metrics(metrics: DataFrame, path: str, run: list[str], fmt: str = "parquet") -> None:
    write_table(metrics.select(*run, *schemas.names(schemas.METRICS)), path, run, fmt)


def write_trace(trace: DataFrame, path: str, run: list[str], fmt: str = "parquet") -> None:
    write_table(trace.select(*run, *schemas.names(schemas.TRACE)), path, run, fmt)


def write_coded_trace(coded: DataFrame, firing: DataFrame, path: str) -> None:
    """A coded trace and its firing times: one row per (event, window), however many lags."""
    write_table(coded, f"{path}/pairs", ["window_type"])
    write_table(firing, f"{path}/firing", ["window_type"])


def read_coded_trace(
    spark: SparkSession, path: str, sweep: Sweep, by: tuple[str, ...] = (), lag_ms: int | None = None
) -> DataFrame:
    """The trace rows of all lags or of one, made as they are read."""
    coded, firing = (spark.read.parquet(f"{path}/{part}") for part in ("pairs", "firing"))
    return trace_view(coded, firing, sweep, by, lag_ms)


def write_series(series: DataFrame, path: str, run: list[str], fmt: str = "csv") -> None:
    rows = series.select(*run, *schemas.names(schemas.SERIES))
    rows = rows.repartitionByRange(*run, "relative_time_s").sortWithinPartitions(*run, "relative_time_s")
    write_table(rows, path, run, fmt)


def write_tradeoff(table: DataFrame, path: str, run_id: str = "run_id") -> None:
    """The trade-off table in its stored layout, sorted by lag. One row per run.

    ``run_id`` is the run's name, a column or an expression over the table.
    """
    kinds = "concat(initcap(window_type), ' Window')"
    rows = table.selectExpr(
        f"{run_id} as Experiment",
        "lag_s as Lag",
        "drop_rate as DropRate",
        "avg_latency_s as AvgLatency",
        "avg_trigger_delay_s as TriggerDelay",
        f"{kinds} as Type",
    )
    write_table(rows.orderBy("Lag", "Experiment"), path, fmt="csv")


def rewrite(rows: DataFrame, source: str, target: str, run: list[str], fmt: str = "parquet") -> None:
    """Write corrected rows next to their source, which stays as it is."""
    if source.rstrip("/") == target.rstrip("/"):
        raise ValueError("write corrected files to a new path")
    write_table(rows, target, run, fmt)
