"""A watermark whose lag follows the disorder of the log.

Time is cut into horizons of arrival time. The lag of a horizon is the disorder
that a given share of the rows of the last horizon before it stayed within, so
a job could have known it in advance. The watermark is the running maximum of
``event_ts - lag``: it never falls, also where the lag grows. Its scan is that of
a fixed lag on shifted event times, so ``seen_ts`` of the result has the lag in it
and every operator that takes a scan and a lag works on it with a lag of 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import floor_div, in_units, ratio
from tidemark.operators.arrival_scan import DISORDER_MS, arrival_scan
from tidemark.operators.prefix import running_sums
from tidemark.session import lookup_join, materialize

PER_MILLE = 990


def disorder_by_horizon(scan: DataFrame, horizon_ms: int, by: tuple[str, ...] = (), per_mille: int = PER_MILLE) -> DataFrame:
    """``horizon, rows, disorder_ms``: what ``per_mille`` of a horizon's rows stay within.

    ``scan`` is a scan of one lane. The value is that of a row, not interpolated.
    Rows without event time do not count; horizons without rows are not there.
    """
    if not 0 < per_mille <= 1000:
        raise ValueError("per_mille lies above 0 and up to 1000")
    keys = [*by, "horizon"]
    rows = scan.where("event_ts is not null")
    rows = rows.selectExpr(*by, f"{floor_div('arrival_ts', horizon_ms)} as horizon", f"{DISORDER_MS} as disorder_ms")
    counts = materialize(rows.groupBy(*keys, "disorder_ms").agg(F.count("*").alias("n")), "disorder")
    ranked = running_sums(counts, keys, "disorder_ms", {"n": "_upto"})
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("rows"))
    placed = lookup_join(ranked, totals, keys).where(f"_upto * 1000 >= {per_mille} * rows")
    return placed.groupBy(*keys, "rows").agg(F.min("disorder_ms").alias("disorder_ms"))


def following_lags(disorder: DataFrame, first_lag_ms: int, by: tuple[str, ...] = (), least_lag_ms: int = 0) -> DataFrame:
    """``horizon, rows, lag_ms``: each horizon takes the disorder of the last one before it.

    The first one takes ``first_lag_ms``; no lag is under ``least_lag_ms``. One row a horizon: a small table.
    """
    before = f"lag(disorder_ms) over ({f'partition by {", ".join(by)} ' if by else ''}order by horizon)"
    lag = f"greatest(coalesce({before}, {first_lag_ms}L), {least_lag_ms}L) as lag_ms"
    return disorder.selectExpr(*by, "horizon", "rows", lag)


def adaptive_scan(
    rows: DataFrame, lags: DataFrame, horizon_ms: int, lanes: int = 1, by: tuple[str, ...] = (), **options
) -> DataFrame:
    """The scan of ``rows`` with the lag of ``lags (horizon, lag_ms)`` inside ``seen_ts``.

    The watermark is ``seen_ts - 1``. ``lag_ms`` is added; a row whose horizon has no
    lag, as a row without event time, moves no watermark.
    """
    timed = rows.withColumn("horizon", F.expr(floor_div("arrival_ts", horizon_ms)))
    timed = lookup_join(timed, lags.select(*by, "horizon", "lag_ms"), [*by, "horizon"], "left").drop("horizon")
    shifted = timed.withColumnRenamed("event_ts", "_event_ts").withColumn("event_ts", F.expr("_event_ts - lag_ms"))
    scanned = arrival_scan(shifted, lanes, by, **options)
    return scanned.withColumn("event_ts", F.col("_event_ts")).select(*rows.columns, "lag_ms", "lane", "seen_ts")


def beside_fixed(adaptive: DataFrame, fixed: DataFrame, lags: DataFrame, unit_ms: int = 1000) -> DataFrame:
    """A trade-off table of lag 0 of the adaptive scan, next to the best fixed lag.

    That is the smallest lag of ``fixed`` that drops no more; null if none does.
    ``mean_lag_s`` is the mean over the rows of the log.
    """
    measures = ["drop_rate", "avg_latency_s", "avg_trigger_delay_s"]
    mean = lags.agg(F.expr(f"{in_units(ratio('sum(rows * lag_ms)', 'sum(rows)'), unit_ms)} as mean_lag_s"))
    ours = lookup_join(adaptive.select("window_type", *measures), mean, [])
    theirs = fixed.selectExpr("window_type", "lag_ms", "lag_s as fixed_lag_s", *[f"{m} as fixed_{m}" for m in measures])
    best = ours.select("window_type", "drop_rate").join(theirs, "window_type").where("fixed_drop_rate <= drop_rate")
    columns = ["fixed_lag_s", *[f"fixed_{m}" for m in measures]]
    best = best.groupBy("window_type").agg(F.min_by(F.struct(*columns), "lag_ms").alias("best"))
    return ours.join(best, "window_type", "left").select("window_type", "mean_lag_s", *measures, *[f"best.{c}" for c in columns])
