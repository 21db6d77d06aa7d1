"""Text form of window results and late events."""

from __future__ import annotations

# Message formats.
WINDOW_FORMAT = "[%d-%s] >>> 🪟 [Win %d] [WM=%d] | Count=%d"
LATE_FORMAT = "[%d] ⚠️ [LATE DROP] ID=%d"


def window_message(task_id: str, kind: str, window_end: str, watermark: str, count: str) -> str:
    return f"format_string('{WINDOW_FORMAT}', {task_id}, upper({kind}), {window_end}, {watermark}, {count})"


def late_message(task_id: str, log_id: str) -> str:
    return f"format_string('{LATE_FORMAT}', {task_id}, {log_id})"
