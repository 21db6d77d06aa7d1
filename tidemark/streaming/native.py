"""Window metrics as a plain Structured Streaming aggregation.

Spark's watermark is the highest event time over all rows and moves between
micro-batches only, and rows for closed windows are dropped silently. Use
``late_split`` to keep them, and the batch replay for per-row watermarks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.parse import lane_key, lane_of
from tidemark.operators.window_metrics import id_gaps
from tidemark.operators.windows import WindowSpec


def window_stream(
    events: DataFrame, spec: WindowSpec, lag_ms: int, lanes: int, run: dict[str, str] | None = None
) -> DataFrame:
    """Streaming metrics of parsed events; state is one row per (key, open window).

    ``run`` adds constant columns, by name and expression, that tell runs apart in
    a shared output. The watermark a window fired at is not known to a plain
    aggregation; ``LateSplit`` has it.
    """
    timed = events.withColumn("event_time", F.expr("timestamp_millis(event_ts)"))
    slide = None if spec.is_tumbling else f"{spec.slide_ms} milliseconds"
    window = F.window("event_time", f"{spec.size_ms} milliseconds", slide)
    grouped = timed.withWatermark("event_time", f"{lag_ms} milliseconds").groupBy(
        window, F.expr(lane_of("log_id", lanes)).alias("task_id")
    )
    counts = grouped.agg(
        F.count("*").alias("count_actual"), F.min("log_id").alias("min_id"), F.max("log_id").alias("max_id")
    )
    rows = counts.selectExpr(
        "task_id",
        f"{lane_key('task_id', lanes)} as key",
        "unix_millis(window.end) as window_end",
        "count_actual",
        "min_id",
        "max_id",
    )
    rows = rows.withColumn("trigger_ts", F.expr("unix_millis(current_timestamp())"))
    rows = id_gaps(rows, lanes).withColumn("lag_system", F.expr("trigger_ts - window_end"))
    return rows.withColumns({name: F.expr(value) for name, value in (run or {}).items()})


def start_native(metrics: DataFrame, output: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append every closed window once to ``output``.

    Processes what is available and ends; with ``trigger``, for example
    ``{"processingTime": "10 seconds"}``, it runs until it is stopped.
    """
    writer = metrics.writeStream.outputMode("append").format("parquet").option("path", output)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
