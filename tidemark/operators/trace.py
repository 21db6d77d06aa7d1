"""Per-event trace of a replayed window job: NORMAL and LATE rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parse import lane_of
from tidemark.operators.lateness import closed, window_pairs
from tidemark.operators.prefix import BLOCK
from tidemark.operators.window_metrics import window_firing
from tidemark.operators.windows import Sweep, last_window_end
from tidemark.session import lookup_join

# Fixed values of the trace format.
NORMAL, LATE, NO_WINDOW = "NORMAL", "LATE", -1


def coded_trace(scan: DataFrame, sweep: Sweep, lanes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per (event, window), for all lags at once.

    ``refused_by`` is the number of the window type's lags, in ascending order, that
    refuse the pair: for the others it is accepted. The row of an event's last window
    (``is_last``) also stands for the late event those lags make of it.
    """
    parts = []
    for spec, lags in sweep:
        refused = " + ".join(f"int({closed(lag)})" for lag in sorted(set(lags)))
        parts.append(
            window_pairs(scan, spec).selectExpr(
                *by,
                f"'{spec.kind}' as window_type",
                f"{lane_of('log_id', lanes)} as task_id",
                "arrival_ts",
                "event_ts",
                "log_id",
                *[c for c in ("content",) if c in scan.columns],
                "window_end",
                f"{refused} as refused_by",
                f"window_end = {last_window_end(spec)} as is_last",
            )
        )
    return reduce(DataFrame.unionByName, parts)


def firing_table(
    scan: DataFrame, sweep: Sweep, by: tuple[str, ...] = (), flush: bool = False, block: int = BLOCK
) -> DataFrame:
    """``fired``, the firing times of a window by the number of its lag; windows that never fire are left out."""
    fired = window_firing(scan, sweep, by, flush, block).where("trigger_ts is not null")
    numbers = " ".join(
        f"when window_type = '{spec.kind}' and lag_ms = {lag} then {k}" for spec, lags in sweep for k, lag in enumerate(sorted(set(lags)))
    )
    entries = f"collect_list(struct(case {numbers} end as lag_no, trigger_ts))"
    return fired.groupBy(*by, "window_type", "window_end").agg(F.expr(f"map_from_entries({entries}) as fired"))


def trace_view(
    coded: DataFrame,
    firing: DataFrame,
    sweep: Sweep,
    by: tuple[str, ...] = (),
    lag_ms: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The trace rows of every lag, or of ``lag_ms`` alone, from a coded trace.

    One NORMAL row per accepted (event, fired window), one LATE row per late event.
    NORMAL rows carry the firing time as ``sys_ts``, LATE rows their arrival time.
    Coded rows are joined with the firing times once, and multiplied by the lags
    afterwards, without moving again; for one lag they are filtered instead. Columns to
    ``keep`` pass through.
    """
    run = [*by, "window_type", "window_end"]
    lags = {spec.kind: sorted(set(ns)) for spec, ns in sweep}
    width = max(map(len, lags.values()))
    if lag_ms is None:
        cases = " ".join(f"when '{kind}' then array({', '.join(f'{n}L' for n in ns)})" for kind, ns in lags.items())
        chosen, each = coded, f"posexplode(case window_type {cases} end) as (lag_no, lag_ms)"
    else:
        cases = " ".join(f"when '{kind}' then {ns.index(lag_ms) if lag_ms in ns else 'null'}" for kind, ns in lags.items())
        number = f"case window_type {cases} end"
        chosen = coded.where(f"{number} >= refused_by or ({number} < refused_by and is_last)")
        each = f"inline(array(struct({number} as lag_no, {lag_ms}L as lag_ms)))"
    joined = lookup_join(chosen, firing, run, how="left", row_width=width).selectExpr("*", each)
    joined = joined.selectExpr("*", "lag_no < refused_by as late", "try_element_at(fired, lag_no) as trigger_ts")
    joined = joined.where("if(late, is_last, trigger_ts is not null)")
    return joined.selectExpr(
        *by,
        "window_type",
        "lag_ms",
        "task_id",
        "if(late, arrival_ts, trigger_ts) as sys_ts",
        "event_ts",
        "log_id",
        *[c for c in ("content",) if c in coded.columns],
        f"if(late, '{LATE}', '{NORMAL}') as status",
        f"if(late, bigint({NO_WINDOW}), window_end) as window_end",
        *keep,
    )


def trace_rows(
    scan: DataFrame,
    sweep: Sweep,
    lanes: int,
    by: tuple[str, ...] = (),
    flush: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """The trace of every window type and lag (``trace_view``), from one pass over the pairs."""
    return trace_view(coded_trace(scan, sweep, lanes, by), firing_table(scan, sweep, by, flush, block), sweep, by)


def trace_totals(trace: DataFrame, run: list[str]) -> DataFrame:
    """A trace condensed to one row per ``sys_ts``: all that series and summaries need."""
    return trace.groupBy(*run, "sys_ts").agg(
        F.expr(f"count_if(status <> '{LATE}') as processed"),
        F.expr(f"count_if(status = '{LATE}') as late"),
        F.expr(f"coalesce(sum(case when status <> '{LATE}' then sys_ts - event_ts end), 0L) as delay_ms"),
    )


def replay_totals(scan: DataFrame, metrics: DataFrame, sweep: Sweep, by: tuple[str, ...] = ()) -> DataFrame:
    """``trace_totals`` of a replay from its window metrics, without the trace rows.

    Accepted events come from the metrics (already combined per window), late
    events are counted per arrival time, so nothing is joined at row level.
    """
    run = [*by, "window_type", "lag_ms"]
    delay = "sum(wait_ms + count_actual * (sys_ts - window_end)) as delay_ms"
    normal = metrics.withColumnRenamed("trigger_ts", "sys_ts").groupBy(*run, "sys_ts")
    normal = normal.agg(F.expr("sum(count_actual) as processed"), F.expr(delay))
    normal = normal.selectExpr(*run, "sys_ts", "processed", "0L as late", "delay_ms")

    overruns, candidates, late_for = [], [], []
    for s, (spec, lags) in enumerate(sweep):
        overruns.append(f"seen_ts - {last_window_end(spec)} as overrun_{s}")
        # Events late for the smallest lag include those late for any other.
        candidates.append(f"overrun_{s} >= {min(lags)}")
        for lag in lags:
            entry = f"named_struct('window_type', '{spec.kind}', 'lag_ms', {lag}L)"
            late_for.append(f"if(overrun_{s} >= {lag}, {entry}, null)")
    late = scan.where("event_ts is not null").selectExpr(*by, "arrival_ts as sys_ts", *overruns)
    late = late.where(" or ".join(candidates)).selectExpr(*by, "sys_ts", f"inline(array({', '.join(late_for)}))")
    late = late.where("lag_ms is not null")
    late = late.selectExpr(*run, "sys_ts", "0L as processed", "1L as late", "0L as delay_ms")

    both = normal.unionByName(late).groupBy(*run, "sys_ts")
    return both.agg(*[F.sum(c).alias(c) for c in ("processed", "late", "delay_ms")])
