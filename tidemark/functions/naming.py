"""Facts packed in run and file names of stored experiment results."""

from __future__ import annotations

# These names and labels are part of the stored file formats.
LAG_PATTERN = r"(\d+(\.\d+)?)klag"
SLIDING_MARK = "slide21k"
TUMBLING_PATTERN = r"(^|[^A-Za-z0-9.])\d+p\d"
TRACE_MARK = "trace"
WINDOW_MARK = "window"


def lag_seconds(name: str) -> str:
    """The number in front of ``klag``; null if there is none."""
    return f"try_cast(nullif(regexp_extract({name}, r'{LAG_PATTERN}', 1), '') as double)"


def window_kind(name: str, tumbling_kind: str = TRACE_MARK) -> str:
    """``sliding``, ``tumbling`` or ``unknown``.

    Names of tumbling runs begin with the number of lanes, a ``p`` and the lag; those of
    sliding runs hold a mark. Tumbling runs keep traces and window metrics apart in the name, so a trace
    run must also be marked as one; use ``WINDOW_MARK`` for window metric runs.
    """
    return f"""case when contains({name}, '{SLIDING_MARK}') then 'sliding'
        when {name} rlike r'{TUMBLING_PATTERN}' and contains({name}, '{tumbling_kind}') then 'tumbling'
        else 'unknown' end"""


def run_prefix(file_name: str) -> str:
    """The part of a per-task file name in front of ``_task-``; null without it."""
    return f"nullif(regexp_extract({file_name}, r'^(.*?)_task-', 1), '')"


def task_number(file_name: str) -> str:
    return rf"try_cast(nullif(regexp_extract({file_name}, r'_task-(\d+)', 1), '') as int)"


def run_name(kind: str, lag_s: str, size_ms: int, slide_ms: int, lanes: int) -> str:
    """Run name of a replay in the stored naming scheme, from column texts."""
    number = f"regexp_replace(string({lag_s}), r'\\.0$', '')"
    if kind == "sliding":
        return f"concat('{SLIDING_MARK}-', {number}, 'klag_Sliding_SZ{size_ms}_SL{slide_ms}_P{lanes}')"
    return f"concat('{lanes}p', {number}, 'klag-all-data-trace_P{lanes}')"
