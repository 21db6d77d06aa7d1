"""Which windows still accept an event, and which events are late.

A window is closed once ``window_end - 1 <= watermark``, that is once
``seen_ts - window_end >= lag``. Whether the watermark includes the event's own
timestamp makes no difference here: an event can never close a window it is in.

``overrun`` is ``seen_ts - window_end``; null (never late) before any watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import floor_div, ratio
from tidemark.operators.windows import Sweep, WindowSpec, assign_windows, last_window_end, windows_held


def with_overrun(scan: DataFrame, spec: WindowSpec, keep: list[str] | None = None) -> DataFrame:
    """Events with the overrun of their latest window: late for every lag up to it."""
    rows = scan.where("event_ts is not null")
    overrun = f"seen_ts - {last_window_end(spec)} as overrun"
    return rows.selectExpr(*(keep if keep is not None else ["*"]), overrun)


def window_pairs(scan: DataFrame, spec: WindowSpec) -> DataFrame:
    """One row per (event, window) with the overrun of that window."""
    pairs = assign_windows(scan.where("event_ts is not null"), spec)
    return pairs.withColumn("overrun", F.expr("seen_ts - window_end"))


def closed(lag_ms: int | str) -> str:
    return f"coalesce(overrun >= {lag_ms}, false)"


def missed_windows(spec: WindowSpec, lag_ms: int | str, overrun: str = "overrun") -> str:
    """How many of an event's windows were closed on arrival, from its latest overrun."""
    held = windows_held(spec)
    still_open = f"{floor_div(f'({lag_ms} - {overrun} - 1)', spec.slide_ms)} + 1"
    return f"coalesce({held} - greatest(least({still_open}, {held}), 0L), 0L)"


def late_events(scan: DataFrame, spec: WindowSpec, lag_ms: int) -> DataFrame:
    """The late output, with how late each event was on arrival."""
    late = with_overrun(scan, spec).where(f"overrun >= {lag_ms}").drop("overrun")
    return late.withColumns({"lag_ms": F.expr(f"bigint({lag_ms})"), "late_by_ms": F.expr("arrival_ts - event_ts")})


def late_events_sweep(scan: DataFrame, sweep: Sweep) -> DataFrame:
    """``late_events`` of every window type and lag, from one pass over the rows.

    Without arrival times there is no ``late_by_ms``.
    """
    overruns, entries = [], []
    for s, (spec, lags) in enumerate(sweep):
        overruns.append(f"seen_ts - {last_window_end(spec)} as _overrun_{s}")
        for lag in lags:
            entries.append(f"if(_overrun_{s} >= {lag}, named_struct('window_type', '{spec.kind}', 'lag_ms', {lag}L), null)")
    rows = scan.where("event_ts is not null").selectExpr("*", *overruns)
    rows = rows.selectExpr(*scan.columns, f"inline(filter(array({', '.join(entries)}), x -> x is not null))")
    return rows.withColumn("late_by_ms", F.expr("arrival_ts - event_ts")) if "arrival_ts" in scan.columns else rows


def partial_misses(scan: DataFrame, spec: WindowSpec, lag_ms: int) -> DataFrame:
    """Accepted events that silently lost some of their windows (sliding only)."""
    rows = with_overrun(scan, spec).where(f"overrun < {lag_ms}")
    rows = rows.withColumns({"lag_ms": F.expr(f"bigint({lag_ms})"), "missed": F.expr(missed_windows(spec, lag_ms))})
    return rows.where("missed > 0").drop("overrun")


def drop_rates(
    scan: DataFrame, specs: list[WindowSpec], lags_ms: list[int], by: tuple[str, ...] = ()
) -> DataFrame:
    """Event counts and drop rates for every window type and lag, in one pass.

    All combinations are conditional sums over the same rows, so the data are
    neither multiplied nor shuffled; only one partial row per task is.

    ``drop_rate_events`` counts events, ``drop_rate_rows`` late rows among trace
    rows (an accepted event has one row per open window), ``pair_loss_rate`` the
    missed (event, window) pairs.
    """
    overruns, sums, outputs = [], ["count(*) as events"], []
    for s, spec in enumerate(specs):
        overruns += [f"seen_ts - {last_window_end(spec)} as overrun_{s}"]
        overruns += [f"{windows_held(spec)} as held_{s}"]
        sums.append(f"coalesce(sum(held_{s}), 0L) as pairs_{s}")
        for k, lag in enumerate(lags_ms):
            missed = missed_windows(spec, lag, f"overrun_{s}")
            sums.append(f"count_if(overrun_{s} >= {lag}) as late_{s}_{k}")
            sums.append(f"coalesce(sum({missed}), 0L) as missed_{s}_{k}")
            outputs.append(
                f"named_struct('window_type', '{spec.kind}', 'lag_ms', {lag}L, 'late', late_{s}_{k}, "
                f"'pairs', pairs_{s}, 'missed_pairs', missed_{s}_{k})"
            )
    rows = scan.where("event_ts is not null").selectExpr(*by, "event_ts", *overruns)
    totals = rows.groupBy(*by).agg(*[F.expr(x) for x in sums])
    flat = totals.selectExpr(*by, "events", f"inline(array({', '.join(outputs)}))")
    return flat.selectExpr(
        "*",
        f"{ratio('late', 'events')} as drop_rate_events",
        f"{ratio('late', 'pairs - missed_pairs + late')} as drop_rate_rows",
        f"{ratio('missed_pairs', 'pairs')} as pair_loss_rate",
    )
