"""The disorder profile of a log as one summary row, from two value counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import in_units, ratio
from tidemark.operators.arrival_scan import DISORDER_MS, arrival_scan
from tidemark.operators.disorder import LONG_DELAY_S
from tidemark.operators.prefix import percentile_of_counts
from tidemark.session import materialize


def disorder_profile(log: DataFrame, by: list[str], unit_ms: int = 1000, **scan_options) -> DataFrame:
    """Delays and disorder per log: means, maxima, shares and 99th percentiles.

    The rows are read once by the scan; delay and disorder are counted per value
    and everything else follows from the two count tables. ``by`` must not be empty.
    """
    scan = arrival_scan(log.select(*by, "arrival_ts", "log_id", "event_ts"), by=tuple(by), **scan_options)
    # The delay is the distance of arrival and event time, so it needs no column.
    values = scan.selectExpr(
        *by, f"inline(array(struct('delay' as kind, arrival_ts - event_ts as ms), struct('lag' as kind, {DISORDER_MS} as ms)))"
    )
    counts = values.groupBy(*by, "kind", "ms").agg(F.count("*").alias("n"))
    counts = materialize(counts, "value-counts")
    p99 = percentile_of_counts(counts, [*by, "kind"], "ms", 0.99)

    delays, lags = "kind = 'delay'", "kind = 'lag'"
    total = f"sum(if({delays}, n, 0L))"
    sums = counts.groupBy(*by).agg(
        F.expr(f"{total} as rows"),
        F.expr(f"{in_units(f'sum(if({delays}, ms * n, 0L))', unit_ms)} / {total} as avg_delay_s"),
        F.expr(f"{in_units(f'max(if({delays}, ms, null))', unit_ms)} as max_delay_s"),
        F.expr(f"{ratio(f'sum(if({delays} and ms > {LONG_DELAY_S * unit_ms}, n, 0L))', total)} as share_over_2s"),
        F.expr(f"sum(if({lags} and ms > 0, n, 0L)) as out_of_order"),
        F.expr(f"{ratio(f'sum(if({lags} and ms > 0, n, 0L))', total)} as out_of_order_share"),
        F.expr(f"{in_units(f'max(if({lags}, ms, null))', unit_ms)} as max_lag_s"),
    )
    tails = p99.groupBy(*by).agg(
        F.expr(f"{in_units(f'max(if({delays}, p_ms, null))', unit_ms)} as p99_delay_s"),
        F.expr(f"{in_units(f'max(if({lags}, p_ms, null))', unit_ms)} as p99_lag_s"),
    )
    return sums.join(tails, by)
