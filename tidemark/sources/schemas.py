"""Column layouts of the files this library reads and writes."""

# File formats.
REPLAY = "send_offset DOUBLE, event_offset DOUBLE, id BIGINT, delay DOUBLE, content STRING"
METRICS = (
    "task_id INT, window_end BIGINT, trigger_ts BIGINT, count_actual BIGINT, count_expected BIGINT, "
    "loss_network BIGINT, lag_system BIGINT, current_wm BIGINT"
)
TRACE = (
    "task_id INT, sys_ts BIGINT, event_ts BIGINT, log_id BIGINT, content STRING, status STRING, window_end BIGINT"
)
SERIES = (
    "relative_time_s BIGINT, throughput DOUBLE, processed_count DOUBLE, drop_rate DOUBLE, avg_delay_processed DOUBLE"
)
TRADEOFF = "Experiment STRING, Lag DOUBLE, DropRate DOUBLE, AvgLatency DOUBLE, TriggerDelay DOUBLE, Type STRING"


def names(layout: str) -> list[str]:
    return [field.split()[0] for field in layout.split(", ")]
