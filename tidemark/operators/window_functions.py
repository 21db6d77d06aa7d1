"""A user's own window functions, without lists of elements.

A function is written as three sets of SQL expressions: ``partial`` aggregates events,
``merge`` aggregates partial results, ``finish`` computes from what is merged. Any
built-in aggregate can be used, sketches included. Events are aggregated once for each
pane, whatever the number of windows, lags and functions; a window that gets a hot
key's events is merged from partial results of many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parse import lane_key
from tidemark.operators.firing import attach_firing
from tidemark.operators.panes import LISTED, pane_groups, windows_of_groups
from tidemark.operators.windows import WindowSpec


RESERVED = set("task_id refused_by window_end window_type lag_ms key pane w first last level node grid slot".split())


@dataclass(frozen=True)
class WindowFunction:
    """``partial`` and ``merge`` have the same names; ``finish`` may use them and the window's columns.

    Names of partial results may not be those of the library's own columns (``RESERVED``).
    ``merge`` has to be associative and commutative over partial results: a ``sum`` of
    counts, a ``min`` of minima, a union of sketches.
    """

    partial: dict[str, str]
    merge: dict[str, str]
    finish: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.partial.keys() != self.merge.keys():
            raise ValueError("partial and merge must name the same columns")
        if taken := RESERVED & self.partial.keys():
            raise ValueError(f"reserved names: {', '.join(sorted(taken))}")


COUNT = WindowFunction({"count_actual": "count(*)"}, {"count_actual": "sum(count_actual)"}, {"count_actual": "count_actual"})

ID_GAPS = WindowFunction(
    {"_ids": "count(*)", "_low": "min(log_id)", "_high": "max(log_id)"},
    {"_ids": "sum(_ids)", "_low": "min(_low)", "_high": "max(_high)"},
    {"count_expected": "_high - _low + 1", "loss_network": "_high - _low + 1 - _ids"},
)


def spread_of(value: str, name: str) -> WindowFunction:
    """Mean and variance of an integer expression, from exact sums."""
    n, s, q = f"_{name}_n", f"_{name}_sum", f"_{name}_squares"
    exact = f"double(cast({n} as decimal(38, 0)) * {q} - cast({s} as decimal(38, 0)) * {s})"
    return WindowFunction(
        {n: f"count({value})", s: f"sum({value})", q: f"sum(cast(({value}) as decimal(19, 0)) * ({value}))"},
        {n: f"sum({n})", s: f"sum({s})", q: f"sum({q})"},
        {f"mean_{name}": f"double({s}) / {n}", f"variance_{name}": f"{exact} / (double({n}) * {n})"},
    )


def apply_functions(
    scan: DataFrame,
    spec: WindowSpec,
    lags_ms: list[int],
    lanes: int,
    functions: list[WindowFunction],
    by: tuple[str, ...] = (),
    flush: bool = False,
    listed: int = LISTED,
) -> DataFrame:
    """One row for every key, lag and window that fires, with the results of all functions.

    Columns: ``by``, ``window_type, lag_ms, task_id, key, window_end, trigger_ts,
    current_wm``, then those of ``finish``. Expressions may use all columns of ``scan``.
    """
    lags, by = sorted(set(lags_ms)), list(by)
    names = [c for f in functions for c in f.partial]
    if len(set(names)) < len(names):
        raise ValueError("two functions share the name of a partial result")
    partials = [F.expr(e).alias(c) for f in functions for c, e in f.partial.items()]
    merges = [F.expr(e).alias(c) for f in functions for c, e in f.merge.items()]
    groups = pane_groups(scan, spec, lags, lanes, by, partials)
    windows = windows_of_groups(groups, spec, lags, by, merges, listed)
    each = f"explode_outer(slice(array({', '.join(f'{lag}L' for lag in lags)}), refused_by + 1, {len(lags)})) as lag_ms"
    keys = [*by, "task_id", "window_end", "lag_ms"]
    merged = windows.selectExpr("*", each).where("lag_ms is not null").groupBy(*keys).agg(*merges)
    merged = merged.withColumn("window_type", F.lit(spec.kind))
    fired = attach_firing(merged, scan, [(spec, lags)], tuple(by), flush).where("trigger_ts is not null")
    fixed = [*by, "window_type", "lag_ms", "task_id", f"{lane_key('task_id', lanes)} as key", "window_end", "trigger_ts", "current_wm"]
    return fired.selectExpr(*fixed, *[f"{e} as {c}" for f in functions for c, e in f.finish.items()])
