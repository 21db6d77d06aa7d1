"""Per-second series and summaries of stored or replayed runs.

Everything works on trace totals (``operators.trace.trace_totals``): one row per
run and ``sys_ts`` with ``processed, late, delay_ms``. All runs of a sweep go
through one job; ``run`` names the columns that tell them apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import in_units, ratio
from tidemark.operators.prefix import BLOCK, dense_range, running_sums
from tidemark.session import lookup_join, materialize

# Smoothing width and default tail cut, in seconds.
SMOOTHING = 5
CUTOFF_SECONDS = 10


def cut_tail(rows: DataFrame, run: list[str], ts: str, cutoff_ms: int) -> DataFrame:
    """Leave out the last ``cutoff_ms`` of every run; adds ``start_ts`` (first time kept).

    If any row of a run is kept, the run's first row is, so both bounds come from
    one aggregation. ``rows`` is read twice and holds aggregates, not raw events.
    """
    bounds = rows.groupBy(*run).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("_last_ts"))
    kept = lookup_join(rows, bounds, run)
    return kept.where(f"{ts} <= _last_ts - {cutoff_ms}").drop("_last_ts")


def run_series(
    totals: DataFrame,
    run: list[str],
    cutoff_s: int = CUTOFF_SECONDS,
    unit_ms: int = 1000,
    block: int = BLOCK,
) -> DataFrame:
    """Smoothed throughput, cumulative drop rate and smoothed delay per second.

    A "second" lasts ``unit_ms``. Seconds without rows count as zeros. Smoothing
    is a centred 5-row mean over the rows there are at the edges. ``totals`` is
    read twice: pass a table or something cheap to compute.
    """
    second = "relative_time_s"
    kept = cut_tail(totals, run, "sys_ts", cutoff_s * unit_ms)
    kept = kept.selectExpr("*", f"(sys_ts - start_ts) div {unit_ms} as {second}")
    seconds = kept.groupBy(*run, second).agg(*[F.sum(c).alias(c) for c in ("processed", "late", "delay_ms")])
    seconds = materialize(seconds.selectExpr("*", "processed + late as total"), "seconds")

    bounds = seconds.groupBy(*run).agg(F.max(second).alias("last_s"))
    grid = dense_range(bounds, "last_s", second, block)

    # Each second adds to its neighbours: a rolling sum without an ordered window.
    half = SMOOTHING // 2
    near = seconds.selectExpr("*", f"explode(sequence({second} - {half}, {second} + {half})) as _near")
    rolled = near.drop(second).withColumnRenamed("_near", second).groupBy(*run, second)
    rolled = rolled.agg(*[F.sum(c).alias(f"{c}_near") for c in ("total", "processed", "delay_ms")])
    keys = [*run, second]
    full = grid.join(seconds.select(*keys, "total", "late"), keys, "left").join(rolled, keys, "left")
    full = running_sums(full.na.fill(0), run, second, {"total": "total_upto", "late": "late_upto"}, block)
    available = f"double(least({second} + {half}, last_s) - greatest({second} - {half}, 0L) + 1)"
    return full.selectExpr(
        *keys,
        f"total_near / {available} as throughput",
        f"processed_near / {available} as processed_count",
        f"{ratio('late_upto', 'total_upto')} as drop_rate",
        f"{ratio(in_units('delay_ms_near', unit_ms), 'processed_near')} as avg_delay_processed",
    )


def run_summary(
    totals: DataFrame, run: list[str], cutoff_s: int = CUTOFF_SECONDS, unit_ms: int = 1000
) -> DataFrame:
    """Rows kept, processed, late, drop rate and mean processing delay per run."""
    kept = cut_tail(totals, run, "sys_ts", cutoff_s * unit_ms)
    sums = kept.groupBy(*run).agg(*[F.sum(c).alias(c) for c in ("processed", "late", "delay_ms")])
    return sums.selectExpr(
        *run,
        "processed + late as rows",
        "processed",
        "late",
        f"{ratio('late', 'processed + late')} as drop_rate",
        f"{ratio(in_units('delay_ms', unit_ms), 'processed')} as avg_latency_s",
    )


def window_summary(
    metrics: DataFrame, run: list[str], cutoff_s: int = CUTOFF_SECONDS, unit_ms: int = 1000
) -> DataFrame:
    """Mean trigger latency per run, every (key, window) row counting once."""
    # Rows of one firing time are combined first, so the bounds join stays small.
    firings = metrics.groupBy(*run, "trigger_ts").agg(
        F.count("*").alias("windows"), F.expr("sum(trigger_ts - window_end) as latency_ms")
    )
    kept = cut_tail(firings, run, "trigger_ts", cutoff_s * unit_ms)
    kept = kept.groupBy(*run).agg(F.sum("windows").alias("windows"), F.sum("latency_ms").alias("latency_ms"))
    return kept.selectExpr(*run, "windows", f"{in_units('latency_ms', unit_ms)} / windows as avg_trigger_delay_s")
