"""Clock calibration of stored runs.

Per file (run and task) the smallest ``system time - window_end`` should be the
lag plus a fixed overhead. A larger deviation is taken as a clock offset and
added to every system time of the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import lookup_join

# Fixed values, in ms: expected overhead, and the offset that is still ignored.
TARGET_EXTRA_MS = 100
MIN_ABS_MS = 10


def clock_offsets(
    rows: DataFrame,
    file_keys: list[str],
    ts: str,
    lag: str = "lag_ms",
    target_extra_ms: int = TARGET_EXTRA_MS,
    min_abs_ms: int = MIN_ABS_MS,
) -> DataFrame:
    """Per file: the offset found, and the one to apply (0 if too small to matter).

    Files whose lag is unknown, or without any fired window, are not in the result.
    """
    valid = rows.where(f"window_end > 0 and {lag} is not null")
    found = valid.groupBy(*file_keys).agg(
        F.expr(f"min({ts} - window_end) as min_lag_system"), F.expr(f"max({lag}) as _lag")
    )
    found = found.selectExpr(
        *file_keys, "min_lag_system", f"_lag + {target_extra_ms} - min_lag_system as offset_ms"
    )
    return found.selectExpr("*", f"if(abs(offset_ms) > {min_abs_ms}, offset_ms, 0L) as applied_ms")


def _shift(rows: DataFrame, ts: str, file_keys: list[str], options: dict) -> DataFrame:
    offsets = clock_offsets(rows, file_keys, ts, **options).select(*file_keys, "applied_ms")
    joined = lookup_join(rows, offsets, file_keys, how="left")
    return joined.withColumn(ts, F.expr(f"bigint({ts} + coalesce(applied_ms, 0L))")).drop("applied_ms")


def calibrate_trace(trace: DataFrame, file_keys: list[str], **options) -> DataFrame:
    """Shift ``sys_ts`` of all rows, late ones too; event times stay."""
    return _shift(trace, "sys_ts", file_keys, options)


def calibrate_metrics(metrics: DataFrame, file_keys: list[str], **options) -> DataFrame:
    """Shift ``trigger_ts`` and derive ``lag_system`` anew."""
    shifted = _shift(metrics, "trigger_ts", file_keys, options)
    return shifted.withColumn("lag_system", F.expr("trigger_ts - window_end"))


def calibrate(rows: DataFrame, file_keys: list[str], **options) -> DataFrame:
    """Pick the right form from the columns present."""
    if {"sys_ts", "window_end"} <= set(rows.columns):
        return calibrate_trace(rows, file_keys, **options)
    if {"trigger_ts", "window_end"} <= set(rows.columns):
        return calibrate_metrics(rows, file_keys, **options)
    raise ValueError("neither a trace nor a window metric table")
