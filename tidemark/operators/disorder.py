"""Disorder profile of an arrival log, before any window job runs.

``by`` names the columns that separate independent logs; the results are per log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import in_units, ratio
from tidemark.operators.arrival_scan import DISORDER_MS
from tidemark.operators.prefix import BLOCK, dense_range, exact_percentile
from tidemark.session import lookup_join, materialize

# 50 thresholds from 0 to 5 s, 50 delay bins, loss targets in percent.
THRESHOLDS = 50
THRESHOLD_MAX_S = 5
DELAY_BINS = 50
LOSS_TARGETS = (1, 5)
LONG_DELAY_S = 2


def replay_stats(log: DataFrame, by: list[str], unit_ms: int = 1000) -> DataFrame:
    """Rows, duration up to the last arrival, mean and largest delay."""
    return log.groupBy(*by).agg(
        F.expr("count(*) as rows"),
        F.expr(f"{in_units('max(arrival_ts) - min(event_ts)', unit_ms)} as duration_s"),
        F.expr(f"{in_units('sum(delay_ms)', unit_ms)} / count(*) as avg_delay_s"),
        F.expr(f"{in_units('max(delay_ms)', unit_ms)} as max_delay_s"),
    )


def delay_summary(log: DataFrame, by: list[str], unit_ms: int = 1000) -> DataFrame:
    """Mean and largest delay, and the share of delays over 2 s."""
    over = f"count_if(delay_ms > {LONG_DELAY_S * unit_ms})"
    return log.groupBy(*by).agg(
        F.expr(f"{in_units('sum(delay_ms)', unit_ms)} / count(*) as avg_delay_s"),
        F.expr(f"{in_units('max(delay_ms)', unit_ms)} as max_delay_s"),
        F.expr(f"{ratio(over, 'count(*)')} as share_over_2s"),
    )


def traffic_density(log: DataFrame, by: list[str], unit_ms: int = 1000, block: int = BLOCK) -> DataFrame:
    """Rows per second of arrival, counted from the first arrival; empty seconds are 0."""
    first = log.groupBy(*by).agg(F.min("arrival_ts").alias("first_ts"))
    placed = lookup_join(log.select(*by, "arrival_ts"), first, by)
    placed = placed.selectExpr(*by, f"(arrival_ts - first_ts) div {unit_ms} as second")
    counts = materialize(placed.groupBy(*by, "second").agg(F.count("*").alias("n")), "density")
    bounds = counts.groupBy(*by).agg(F.max("second").alias("last"))
    grid = dense_range(bounds, "last", "second", block).drop("last")
    return grid.join(counts, [*by, "second"], "left").na.fill(0, ["n"])


def delay_histogram(log: DataFrame, by: list[str], bins: int = DELAY_BINS) -> DataFrame:
    """Equal bins from the smallest to the largest delay, the last one closed."""
    bounds = log.groupBy(*by).agg(F.min("delay_ms").alias("low"), F.max("delay_ms").alias("high"))
    bounds = materialize(bounds, "delay-bounds")
    placed = lookup_join(log.select(*by, "delay_ms"), bounds, by, right_rows=bounds.count())
    index = f"least((delay_ms - low) * {bins} div greatest(high - low, 1L), {bins - 1}L) as bin"
    counts = placed.selectExpr(*by, index).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    grid = bounds.selectExpr("*", f"explode(sequence(0L, {bins - 1}L)) as bin")
    return grid.join(counts, [*by, "bin"], "left").selectExpr(
        *by, "bin", f"low + bin * (high - low) / {float(bins)}D as bin_start_ms", "coalesce(n, 0L) as n"
    )


def disorder_stats(scan: DataFrame, by: list[str], unit_ms: int = 1000) -> DataFrame:
    """Count and share of rows behind the running maximum, and the largest distance."""
    behind = f"count_if({DISORDER_MS} > 0)"
    return scan.groupBy(*by).agg(
        F.expr("count(*) as rows"),
        F.expr(f"{behind} as out_of_order"),
        F.expr(f"{ratio(behind, 'count(*)')} as out_of_order_share"),
        F.expr(f"{in_units(f'max({DISORDER_MS})', unit_ms)} as max_lag_s"),
    )


def lag_loss_curve(scan: DataFrame, by: list[str], unit_ms: int = 1000) -> DataFrame:
    """Share of rows whose disorder exceeds each threshold, from one count per step.

    Threshold ``i`` is ``5 s * i / 49``. A row exceeds exactly the thresholds below
    its step, so counting the steps and summing from above gives the whole curve.
    """
    last, full = THRESHOLDS - 1, THRESHOLD_MAX_S * unit_ms
    step = f"least(({DISORDER_MS} * {last} + {full - 1}) div {full}, {THRESHOLDS}L) as step"
    counts = scan.selectExpr(*by, step).groupBy(*by, "step").agg(F.count("*").alias("n"))
    # From here on a log has at most 51 rows: add each step to all thresholds below it.
    below = counts.selectExpr(*by, "step", "n", f"explode(sequence(0L, {last}L)) as threshold_no")
    points = below.groupBy(*by, "threshold_no").agg(
        F.expr("sum(if(step > threshold_no, n, 0L)) as dropped"), F.expr("sum(n) as rows")
    )
    return points.selectExpr(
        *by,
        "threshold_no",
        f"threshold_no * {float(THRESHOLD_MAX_S)}D / {float(last)}D as threshold_s",
        "dropped",
        f"{ratio('dropped', 'rows')} * 100 as loss_percent",
    )


def loss_targets(curve: DataFrame, by: list[str], targets: tuple[int, ...] = LOSS_TARGETS) -> DataFrame:
    """For each target the threshold whose loss is nearest, the first one on ties."""
    wanted = ", ".join(f"{float(t)}D" for t in targets)
    rows = curve.selectExpr("*", f"explode(array({wanted})) as target_percent")
    nearest = """min_by(struct(threshold_s, loss_percent),
                        struct(abs(loss_percent - target_percent), threshold_no)) as nearest"""
    found = rows.groupBy(*by, "target_percent").agg(F.expr(nearest))
    return found.select(*by, "target_percent", "nearest.threshold_s", "nearest.loss_percent")


def delay_percentile(log: DataFrame, by: list[str], share: float = 0.99, unit_ms: int = 1000) -> DataFrame:
    """Exact interpolated percentile of the delay."""
    found = exact_percentile(log.select(*by, "delay_ms"), by, "delay_ms", share)
    return found.selectExpr(*by, f"{in_units('p_delay_ms', unit_ms)} as delay_s")


def disorder_percentile(scan: DataFrame, by: list[str], share: float = 0.99, unit_ms: int = 1000) -> DataFrame:
    """The same for the disorder of the rows: a data-driven choice of the lag."""
    rows = scan.selectExpr(*by, f"{DISORDER_MS} as disorder_ms")
    found = exact_percentile(rows, by, "disorder_ms", share)
    return found.selectExpr(*by, f"{in_units('p_disorder_ms', unit_ms)} as disorder_s")
