"""SQL text of small expressions used everywhere. Times are BIGINT epoch milliseconds."""

from __future__ import annotations


def floor_div(value: str, width: int) -> str:
    """Integer floor division, also right for negative values."""
    return f"(({value} - pmod({value}, {width})) div {width})"


def ratio(part: str, whole: str) -> str:
    """``part / whole`` with 0.0 where the whole is 0 or missing."""
    return f"coalesce(try_divide(double({part}), double({whole})), 0D)"


def in_units(millis: str, unit_ms: int = 1000) -> str:
    """Milliseconds in seconds (or in any other unit of ``unit_ms``)."""
    return f"(double({millis}) / {float(unit_ms)}D)"


def epoch_ms(timestamp: str) -> str:
    """Epoch milliseconds of a TIMESTAMP or TIMESTAMP_NTZ in a UTC session."""
    return f"unix_millis(cast({timestamp} as timestamp))"


def percent_text(share: str) -> str:
    return f"format_string('%.2f%%', {share} * 100)"
