"""Per (key, window) metrics of a replayed window job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parse import lane_key, lane_of
from tidemark.operators.firing import attach_firing
from tidemark.operators.lateness import window_pairs
from tidemark.operators.panes import sliding_counts, window_ends_of
from tidemark.operators.prefix import BLOCK
from tidemark.operators.windows import Sweep, WindowSpec


def window_counts(
    scan: DataFrame, spec: WindowSpec, lags_ms: list[int], lanes: int, by: tuple[str, ...] = ()
) -> DataFrame:
    """Accepted events per (key, window, lag): count, lowest and highest id, waiting time.

    A pair accepted for one lag is accepted for every larger one, so pairs are
    counted once, by the smallest lag that accepts them, and the few counts of a
    window are added up over the lags afterwards. Counts are combined before the
    shuffle: neither a hot window nor the number of lags multiplies the data, nor
    does the number of windows an event is in (``operators.panes``).
    ``wait_ms`` sums the distance to the window end, which stays small, unlike
    epoch times.
    """
    lags = sorted(set(lags_ms))
    keys = [*by, "task_id", "window_end"]
    counts = sliding_counts(scan, spec, lags, lanes, by) if not spec.is_tumbling else _tumbling_counts(scan, spec, lags, lanes, by)
    all_lags = f"array({', '.join(f'{lag}L' for lag in lags)})"
    # explode_outer: the planner would turn the test of an empty array, for pairs no
    # lag accepts, into a costly filter on the rows.
    each = counts.selectExpr("*", f"explode_outer(slice({all_lags}, refused_by + 1, {len(lags)})) as lag_ms")
    totals = each.where("lag_ms is not null").groupBy(*keys, "lag_ms").agg(
        F.sum("n").alias("count_actual"),
        F.min("low").alias("min_id"),
        F.max("high").alias("max_id"),
        F.sum("wait").alias("wait_ms"),
    )
    # The key is a function of the task, so it need not be grouped by.
    return totals.selectExpr("*", f"{lane_key('task_id', lanes)} as key", f"'{spec.kind}' as window_type")


def _tumbling_counts(scan: DataFrame, spec: WindowSpec, lags: list[int], lanes: int, by: tuple[str, ...]) -> DataFrame:
    refused_by = " + ".join(f"int(coalesce(overrun >= {lag}, false))" for lag in lags)
    pairs = window_pairs(scan, spec).selectExpr(
        *by,
        f"{lane_of('log_id', lanes)} as task_id",
        "window_end",
        "log_id",
        "window_end - event_ts as wait",
        f"{refused_by} as refused_by",
    )
    return pairs.groupBy(*by, "task_id", "window_end", "refused_by").agg(
        F.count("*").alias("n"), F.min("log_id").alias("low"), F.max("log_id").alias("high"), F.sum("wait").alias("wait")
    )


def id_gaps(metrics: DataFrame, lanes: int) -> DataFrame:
    """Loss estimates from gaps in the ids.

    ``count_expected`` assumes consecutive ids; a key holds every ``lanes``-th id
    only, which ``count_expected_stride`` takes into account.
    """
    return metrics.selectExpr(
        "*",
        "bigint(max_id - min_id + 1) as count_expected",
        "bigint(max_id - min_id + 1) - count_actual as loss_network",
        f"bigint((max_id - min_id) div {lanes} + 1) as count_expected_stride",
        f"bigint((max_id - min_id) div {lanes} + 1) - count_actual as loss_stride",
    )


def window_metrics(
    scan: DataFrame,
    sweep: Sweep,
    lanes: int,
    by: tuple[str, ...] = (),
    flush: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """One metric row per (key, window) that fires, for every window type and lag."""
    counts = reduce(DataFrame.unionByName, [window_counts(scan, spec, lags, lanes, by) for spec, lags in sweep])
    fired = attach_firing(counts, scan, sweep, by, flush, block).where("trigger_ts is not null")
    return id_gaps(fired, lanes).withColumn("lag_system", F.expr("trigger_ts - window_end"))


def window_firing(
    scan: DataFrame, sweep: Sweep, by: tuple[str, ...] = (), flush: bool = False, block: int = BLOCK
) -> DataFrame:
    """Firing time of every non-empty window for every lag; nulls while pending."""
    parts = []
    for spec, lags in sweep:
        ends = window_ends_of(scan, spec, by)
        each = f"explode(array({', '.join(f'{lag}L' for lag in lags)})) as lag_ms"
        parts.append(ends.selectExpr("*", f"'{spec.kind}' as window_type", each))
    return attach_firing(reduce(DataFrame.unionByName, parts), scan, sweep, by, flush, block)
