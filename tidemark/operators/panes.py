"""Sliding windows from panes: an event is aggregated once, however many windows hold it.

Window borders cut the time axis into panes, and all events of a pane are in the same
windows. Which of them still accept an event depends on what had been seen when it
came, so events of a pane are added up by the number of windows they miss for each
lag; nearly all miss none. The windows that accept such a group are neighbours: a run
of windows is cut into dyadic nodes, at most two of a size, groups are added up by
node, and a window takes the nodes above it. Per group that is a logarithm of size
over slide; the events themselves are shuffled as partial sums of their pane.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arith import floor_div
from tidemark.functions.parse import lane_of
from tidemark.operators.lateness import missed_windows
from tidemark.operators.windows import WindowSpec, last_window_end, windows_held
from tidemark.session import same_keys

# Up to so many windows an event, the windows of a group are listed one by one.
LISTED = 8
BLOCK = 4_096


def pane_start(spec: WindowSpec, ts: str = "event_ts") -> str:
    """Latest window border at or before ``ts``: windows start at multiples of the slide."""
    rest = spec.size_ms % spec.slide_ms
    inside = f"pmod({ts}, {spec.slide_ms})"
    return f"({ts} - {inside})" if not rest else f"({ts} - {inside} + if({inside} >= {rest}, {rest}L, 0L))"


def last_window(spec: WindowSpec, ts: str = "pane") -> str:
    """Number of the latest window that holds ``ts``; window ``w`` starts at ``w * slide``."""
    return floor_div(ts, spec.slide_ms)


def pane_groups(
    scan: DataFrame, spec: WindowSpec, lags: list[int], lanes: int, by: list[str], partials: list
) -> DataFrame:
    """``partials`` of the events by key, pane and windows missed for each of the sorted ``lags``."""
    missed = [f"missed_{k}" for k in range(len(lags))]
    rows = scan.where("event_ts is not null").selectExpr(
        "*", f"{lane_of('log_id', lanes)} as task_id", f"{pane_start(spec)} as pane", f"seen_ts - {last_window_end(spec)} as overrun"
    )
    rows = rows.selectExpr("*", *[f"{missed_windows(spec, lag)} as {m}" for lag, m in zip(lags, missed, strict=True)])
    return rows.groupBy(*by, "task_id", "pane", *missed).agg(*partials)


def pane_counts(scan: DataFrame, spec: WindowSpec, lags: list[int], lanes: int, by: list[str]) -> DataFrame:
    """Number, lowest and highest id, and time into the pane."""
    ids = [F.count("*").alias("n"), F.min("log_id").alias("low"), F.max("log_id").alias("high")]
    return pane_groups(scan, spec, lags, lanes, by, [*ids, F.expr("sum(event_ts - pane) as beyond")])


def accepting_runs(panes: DataFrame, spec: WindowSpec, lags: list[int]) -> DataFrame:
    """Runs ``first..last`` of windows that accept a group by ``refused_by`` and no smaller lag."""
    held, runs = windows_held(spec, "pane"), []
    for k in range(len(lags)):
        upto = "__upto" if k == 0 else f"__upto - __held + missed_{k - 1}"
        runs.append(f"struct({k} as refused_by, __upto - __held + 1 + missed_{k} as first, {upto} as last)")
    rows = panes.selectExpr("*", f"{last_window(spec)} as __upto", f"{held} as __held")
    rows = rows.selectExpr("*", f"inline(filter(array({', '.join(runs)}), r -> r.first <= r.last))")
    return rows.drop("__upto", "__held", *[f"missed_{k}" for k in range(len(lags))])


def _nodes(levels: int) -> str:
    """The dyadic nodes of ``first..last``, as an array of level and number."""
    low, high = "-shiftright(-first, l)", "(shiftright(last + 1, l) - 1)"
    ends = [f"if({low} <= {high} and {low} & 1 = 1, struct(l as level, {low} as node), null)"]
    ends.append(f"if({low} <= {high} and {high} & 1 = 0, struct(l as level, {high} as node), null)")
    return f"filter(flatten(transform(sequence(0, {levels}), l -> array({', '.join(ends)}))), x -> x is not null)"


def _levels(spec: WindowSpec) -> int:
    """The highest level a run of windows can fill a node of."""
    return (-(-spec.size_ms // spec.slide_ms)).bit_length() - 1


def held_windows(panes: DataFrame, spec: WindowSpec, by: list[str]) -> DataFrame:
    """Every window that holds a pane, once, by number ``w``.

    A pane adds the windows after those of the pane before it, so windows are listed
    about once; what blocks of panes have in common at their border goes at the end.
    """
    ends = panes.groupBy(*by, F.expr(last_window(spec)).alias("last"))
    ends = ends.agg(F.expr(f"min({last_window(spec)} - {windows_held(spec, 'pane')} + 1) as first"))
    earlier = Window.partitionBy(*by, F.expr(floor_div("last", BLOCK))).orderBy("last")
    ends = ends.withColumn("_before", F.max("last").over(earlier.rowsBetween(Window.unboundedPreceding, -1)))
    listed = ends.selectExpr(*by, "explode(sequence(greatest(first, coalesce(_before + 1, first)), last)) as w")
    return listed.distinct()


def window_ends_of(scan: DataFrame, spec: WindowSpec, by: tuple[str, ...] = ()) -> DataFrame:
    """``window_end`` of every window that holds an event."""
    panes = scan.where("event_ts is not null").selectExpr(*by, f"{pane_start(spec)} as pane").distinct()
    if spec.is_tumbling:
        return panes.selectExpr(*by, f"pane + {spec.size_ms} as window_end")
    return held_windows(panes, spec, list(by)).selectExpr(*by, f"w * {spec.slide_ms} + {spec.size_ms} as window_end")


def windows_of_groups(
    groups: DataFrame, spec: WindowSpec, lags: list[int], by: list[str], merges: list, listed: int = LISTED
) -> DataFrame:
    """``merges`` of groups of events (by pane and ``missed_*``) for every key, window and ``refused_by``."""
    keys = [*by, "task_id", "refused_by"]
    end = f"w * {spec.slide_ms} + {spec.size_ms} as window_end"
    if -(-spec.size_ms // spec.slide_ms) <= listed:
        pairs = accepting_runs(groups, spec, lags).selectExpr("*", "explode(sequence(first, last)) as w")
        return pairs.selectExpr("*", end).groupBy(*keys, "window_end").agg(*merges)
    runs = accepting_runs(groups, spec, lags).selectExpr("*", f"inline({_nodes(_levels(spec))})")
    nodes = runs.groupBy(*keys, "level", "node").agg(*merges)
    above = f"explode(sequence(0, {_levels(spec)})) as level"
    windows = held_windows(groups, spec, by).selectExpr(*by, "w", above).selectExpr("*", "shiftright(w, level) as node")
    pairs = same_keys(nodes, windows, [*by, "level", "node"])
    return pairs.selectExpr("*", end).groupBy(*keys, "window_end").agg(*merges)


def sliding_counts(
    scan: DataFrame, spec: WindowSpec, lags: list[int], lanes: int, by: tuple[str, ...] = (), listed: int = LISTED
) -> DataFrame:
    """Pairs of event and window by key, window and ``refused_by``, the number of lags that refuse them.

    Columns ``n, low, high`` (ids) and ``wait`` (time to the window end, summed).
    """
    by, keys = list(by), [*by, "task_id", "refused_by"]
    panes = pane_counts(scan, spec, lags, lanes, by)
    sums = [F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")]
    if -(-spec.size_ms // spec.slide_ms) <= listed:
        pairs = accepting_runs(panes, spec, lags).selectExpr("*", "explode(sequence(first, last)) as w")
        pairs = pairs.selectExpr(*keys, f"w * {spec.slide_ms} + {spec.size_ms} as window_end", "pane", "n", "low", "high", "beyond")
        wait = F.expr("sum(n * (window_end - pane) - beyond) as wait")
        return pairs.groupBy(*keys, "window_end").agg(*sums, wait)

    # Times count from the start of a node, so sums stay small.
    runs = accepting_runs(panes, spec, lags).selectExpr("*", f"inline({_nodes(_levels(spec))})")
    start = f"shiftleft(node, level) * {spec.slide_ms}"
    nodes = runs.groupBy(*keys, "level", "node").agg(*sums, F.expr(f"sum(n * (pane - {start}) + beyond) as beyond"))
    above = f"explode(sequence(0, {_levels(spec)})) as level"
    windows = held_windows(panes, spec, by).selectExpr(*by, "w", above).selectExpr("*", "shiftright(w, level) as node")
    pairs = same_keys(nodes, windows, [*by, "level", "node"])
    end = f"w * {spec.slide_ms} + {spec.size_ms}"
    pairs = pairs.selectExpr(*keys, f"{end} as window_end", "n", "low", "high", f"n * ({end} - {start}) - beyond as wait")
    return pairs.groupBy(*keys, "window_end").agg(*sums, F.sum("wait").alias("wait"))
