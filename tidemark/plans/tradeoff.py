"""Lag sweeps and the completeness-versus-latency table across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import in_units
from tidemark.functions.naming import TRACE_MARK, WINDOW_MARK, lag_seconds, window_kind
from tidemark.operators.series import run_summary, window_summary
from tidemark.operators.trace import replay_totals
from tidemark.operators.window_metrics import window_metrics
from tidemark.operators.windows import Sweep
from tidemark.session import materialize

RUN = ["window_type", "lag_ms"]


def replay_sweep(
    scan: DataFrame, sweep: Sweep, lanes: int, by: tuple[str, ...] = (), flush: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Window metrics and trace totals of every (window type, lag) from one scan of the log."""
    metrics = window_metrics(scan, sweep, lanes, by, flush)
    return metrics, materialize(replay_totals(scan, metrics, sweep, by), "trace-totals")


def join_summaries(traces: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Trigger delays onto trace summaries of the same lag and window type; 0.0 if none."""
    joined = traces.join(windows, keys, "left")
    return joined.withColumn("avg_trigger_delay_s", F.expr("coalesce(avg_trigger_delay_s, 0D)"))


def tradeoff_table(
    totals: DataFrame, metrics: DataFrame, run: list[str] = RUN, cutoff_s: int = 20, unit_ms: int = 1000
) -> DataFrame:
    """Drop rate, processing latency and trigger latency by lag and window type."""
    traces = run_summary(totals, run, cutoff_s, unit_ms)
    windows = window_summary(metrics, run, cutoff_s, unit_ms).drop("windows")
    joined = join_summaries(traces, windows, run)
    columns = ["drop_rate", "avg_latency_s", "avg_trigger_delay_s"]
    return joined.selectExpr(*run, f"{in_units('lag_ms', unit_ms)} as lag_s", *columns).orderBy(
        "lag_ms", "window_type"
    )


def tradeoff_from_summaries(trace_summaries: DataFrame, window_summaries: DataFrame) -> DataFrame:
    """The same table from stored summary texts (``sources.summaries``).

    Runs without a lag in their name, or of unknown type, are left out;
    ``unknown_runs`` lists them. If several
    runs share lag and type, the trigger delay of the first name is used.
    """
    lag = f"{lag_seconds('run_id')} as lag_s"
    traces = trace_summaries.selectExpr("*", lag, f"{window_kind('run_id')} as window_type")
    traces = traces.where("lag_s is not null and window_type <> 'unknown'")
    windows = window_summaries.selectExpr("*", lag, f"{window_kind('run_id', WINDOW_MARK)} as window_type")
    windows = windows.groupBy("lag_s", "window_type").agg(
        F.min_by("avg_trigger_delay_s", "run_id").alias("avg_trigger_delay_s")
    )
    joined = join_summaries(traces, windows, ["lag_s", "window_type"])
    columns = ["run_id", "lag_s", "drop_rate", "avg_latency_s", "avg_trigger_delay_s", "window_type"]
    return joined.select(*columns).orderBy("lag_s", "run_id")


def unknown_runs(summaries: DataFrame, kind_mark: str = TRACE_MARK) -> DataFrame:
    """The runs ``tradeoff_from_summaries`` leaves out, with what their name lacks."""
    rows = summaries.selectExpr("run_id", f"{lag_seconds('run_id')} as lag_s", f"{window_kind('run_id', kind_mark)} as window_type")
    reason = "case when lag_s is null then 'no lag' else 'unknown type' end as reason"
    return rows.where("lag_s is null or window_type = 'unknown'").selectExpr("run_id", reason)


def sweet_spot(table: DataFrame, max_drop_rate: float = 0.02) -> DataFrame:
    """Per window type the smallest lag that keeps the drop rate within the target."""
    columns = ["lag_s", "drop_rate", "avg_latency_s", "avg_trigger_delay_s"]
    good = table.where(F.col("drop_rate") <= max_drop_rate)
    best = good.groupBy("window_type").agg(F.min_by(F.struct(*columns), "lag_ms").alias("best"))
    return best.select("window_type", *[f"best.{c}" for c in columns])
