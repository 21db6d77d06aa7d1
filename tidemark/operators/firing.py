"""When each window fires.

The watermark only rises, so a window with end ``e`` fires at the first row with
``seen_ts >= e + lag``. It is enough to keep, per slot of ``seen_ts``, the first
row that reached the slot; a window then takes the next slot at or above its
threshold. The slot table grows with the time span, not with the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import floor_div
from tidemark.operators.prefix import BLOCK, min_at_or_after
from tidemark.operators.windows import Sweep, WindowSpec
from tidemark.session import lookup_join

END_OF_TIME = 2**63 - 1

Grid = tuple[int, int]


def _own_grid(spec: WindowSpec, lag: int) -> Grid:
    """Step and offset of the thresholds ``window_end + lag`` of one replay."""
    return spec.slide_ms, (spec.size_ms + lag) % spec.slide_ms


def slot_grids(sweep: Sweep) -> list[Grid]:
    """Grids on which every threshold of the sweep is a slot border.

    One grid with a common step if that gives no more slots than separate grids,
    otherwise one grid for each slide and remainder.
    """
    grids = sorted({_own_grid(spec, lag) for spec, lags in sweep for lag in lags})
    step = math.gcd(*[part for grid in grids for part in grid])
    return [(step, 0)] if sum(step / slide for slide, _ in grids) >= 1 else grids


def _slot(grid: Grid, value: str) -> str:
    step, offset = grid
    return floor_div(f"({value} - {offset})", step)


def watermark_steps(scan: DataFrame, grids: list[Grid], by: list[str]) -> DataFrame:
    """Per slot of ``seen_ts``: arrival time and ``seen_ts`` of the first row in it."""
    rows = scan.where("seen_ts is not null")
    if len(grids) == 1:
        placed = ["0 as grid", f"{_slot(grids[0], 'seen_ts')} as slot"]
    else:
        slots = [f"struct({g} as grid, {_slot(grid, 'seen_ts')} as slot)" for g, grid in enumerate(grids)]
        placed = [f"inline(array({', '.join(slots)}))"]
    rows = rows.selectExpr(*by, "arrival_ts", "seen_ts", *placed)
    return rows.groupBy(*by, "grid", "slot").agg(
        F.min("arrival_ts").alias("trigger_ts"), F.min("seen_ts").alias("fired_seen_ts")
    )


def attach_firing(
    windows: DataFrame,
    scan: DataFrame,
    sweep: Sweep,
    by: tuple[str, ...] = (),
    flush: bool = False,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``trigger_ts`` and ``current_wm`` to rows with ``window_type, lag_ms, window_end``.

    Windows the log never closes keep nulls there; ``flush`` fires them with the
    last arrival and the final watermark instead.
    """
    by = list(by)
    grids = slot_grids(sweep)
    steps = watermark_steps(scan, grids, by)
    windows = _with_slot(windows, sweep, grids)
    fired = min_at_or_after(windows, steps, [*by, "grid"], "slot", ["trigger_ts", "fired_seen_ts"], block)
    fired = fired.withColumn("current_wm", F.expr("fired_seen_ts - lag_ms - 1"))
    if flush:
        fired = _flush(fired, scan, by)
    return fired.drop("grid", "slot", "fired_seen_ts")


def _with_slot(windows: DataFrame, sweep: Sweep, grids: list[Grid]) -> DataFrame:
    """Grid and slot of the threshold ``window_end + lag``."""
    grid = "0"
    if len(grids) > 1:
        cases = [
            f"when window_type = '{spec.kind}' and lag_ms = {lag} then {grids.index(_own_grid(spec, lag))}"
            for spec, lags in sweep
            for lag in lags
        ]
        grid = f"case {' '.join(cases)} end"
    slots = " ".join(f"when {g} then {_slot(grids[g], '(window_end + lag_ms)')}" for g in range(len(grids)))
    return windows.withColumn("grid", F.expr(grid)).withColumn("slot", F.expr(f"case grid {slots} end"))


def _flush(fired: DataFrame, scan: DataFrame, by: list[str]) -> DataFrame:
    ends = scan.groupBy(*by).agg(F.max("arrival_ts").alias("_last_arrival"))
    fired = lookup_join(fired, ends, by)
    return fired.withColumns(
        {
            "current_wm": F.coalesce("current_wm", F.lit(END_OF_TIME)),
            "trigger_ts": F.coalesce("trigger_ts", "_last_arrival"),
        }
    ).drop("_last_arrival")
