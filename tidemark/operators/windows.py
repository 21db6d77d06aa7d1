"""Epoch-aligned event-time windows on BIGINT milliseconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import floor_div


@dataclass(frozen=True)
class WindowSpec:
    kind: str
    size_ms: int
    slide_ms: int

    def __post_init__(self):
        if not 0 < self.slide_ms <= self.size_ms:
            raise ValueError("need 0 < slide <= size, or events would be in no window")

    @property
    def is_tumbling(self) -> bool:
        return self.size_ms == self.slide_ms


# Window types with the lags (ms) to replay each of them with.
Sweep = list[tuple[WindowSpec, list[int]]]


def tumbling(size_ms: int) -> WindowSpec:
    return WindowSpec("tumbling", size_ms, size_ms)


def sliding(size_ms: int, slide_ms: int) -> WindowSpec:
    return WindowSpec("sliding", size_ms, slide_ms)


def last_window_end(spec: WindowSpec, ts: str = "event_ts") -> str:
    """End of the latest window ``[end - size, end)`` that holds ``ts``."""
    return f"({ts} - pmod({ts}, {spec.slide_ms}) + {spec.size_ms})"


def windows_held(spec: WindowSpec, ts: str = "event_ts") -> str:
    """Number of windows that hold ``ts``."""
    if spec.size_ms % spec.slide_ms == 0:
        return f"{spec.size_ms // spec.slide_ms}L"
    return f"({floor_div(f'({spec.size_ms - 1} - pmod({ts}, {spec.slide_ms}))', spec.slide_ms)} + 1)"


def window_ends(spec: WindowSpec, ts: str = "event_ts") -> str:
    """Ends of all windows that hold ``ts``, ascending."""
    last = last_window_end(spec, ts)
    return f"sequence({last} - ({windows_held(spec, ts)} - 1) * {spec.slide_ms}, {last}, {spec.slide_ms}L)"


def assign_windows(rows: DataFrame, spec: WindowSpec) -> DataFrame:
    """One row per (event, window) with the column ``window_end``."""
    if spec.is_tumbling:
        return rows.withColumn("window_end", F.expr(last_window_end(spec)))
    return rows.withColumn("window_end", F.expr(f"explode({window_ends(spec)})"))
