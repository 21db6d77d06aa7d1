"""Windows and late output of one stateful operator with event-time timers.

Spark's own window aggregation drops late rows silently. Here every (event,
window) pair goes to the state of its window, which compares it with the
watermark of the batches before: an open window counts the event, and an event
whose last window is closed comes out as late, with the watermark that it met.
A timer at the end of the window brings out its counts and frees its state.

State is one row for each (task, window, part). ``parts`` splits a window over
tasks, since most events of a batch lie in one window; ``window_metrics`` adds
the parts up. Output is appended once (file sink and checkpoint), so a restart
goes on where the stream ended.

The watermark is Spark's: the highest event time of earlier batches, less the
lag and one. For a union of streams Spark takes the smallest of theirs
(``spark.sql.streaming.multipleWatermarkPolicy``). It starts at the epoch: event
times before 1970 count as late. Events without an event time are left out. Windows
still open when the input ends have no output. The workers of the operator need
the ``protobuf`` package and Spark's RocksDB state store, which ``start`` sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.functions.parse import lane_key, lane_of
from tidemark.operators.trace import LATE, NO_WINDOW, NORMAL
from tidemark.operators.window_metrics import id_gaps
from tidemark.operators.windows import WindowSpec, assign_windows, last_window_end

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

WINDOW = "WINDOW"
COUNTS = ["count_actual", "min_id", "max_id"]
OUTPUT = (
    "status STRING, task_id BIGINT, window_end BIGINT, current_wm BIGINT, sys_ts BIGINT, "
    "event_ts BIGINT, log_id BIGINT, content STRING, count_actual BIGINT, min_id BIGINT, max_id BIGINT"
)
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
WHOLE = [c for c in COLUMNS if c not in ("status", "content")]


def _rows(rows: pd.DataFrame, **values) -> pd.DataFrame:
    """``rows`` in the layout of the output; columns they lack are null."""
    rows = rows.assign(**values).reindex(columns=COLUMNS)
    return rows.astype(dict.fromkeys(WHOLE, "Int64") | dict.fromkeys(["status", "content"], object))


class WindowState(StatefulProcessor):
    """Counts of one (task, window, part), and the late events that had it as last window."""

    def __init__(self, keep_events: bool):
        self.keep_events = keep_events

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "count_actual BIGINT, min_id BIGINT, max_id BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        task, end, _ = map(int, key)
        wm, now = timerValues.getCurrentWatermarkInMs(), timerValues.getCurrentProcessingTimeInMs()
        place = {"task_id": task, "current_wm": wm, "sys_ts": now}
        if end - 1 <= wm:
            for batch in rows:
                late = batch[batch["is_last"]]
                if len(late):
                    yield _rows(late, status=LATE, window_end=NO_WINDOW, **place)
            return
        known = self.counts.get() if self.counts.exists() else None
        if known is None:
            self.handle.registerTimer(end - 1)
        total, low, high = known or (0, None, None)
        for batch in rows:
            total += len(batch)
            ids = batch["log_id"].dropna()
            if len(ids):
                low = min(int(ids.min()), low if low is not None else int(ids.min()))
                high = max(int(ids.max()), high if high is not None else int(ids.max()))
            if self.keep_events:
                yield _rows(batch, status=NORMAL, window_end=end, **place)
        self.counts.update((total, low, high))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        counts = self.counts.get()
        self.counts.clear()
        yield _rows(
            pd.DataFrame([counts], columns=COUNTS, dtype="Int64"),
            status=WINDOW,
            task_id=int(key[0]),
            window_end=int(key[1]),
            current_wm=timerValues.getCurrentWatermarkInMs(),
            sys_ts=timerValues.getCurrentProcessingTimeInMs(),
        )

    def close(self) -> None:
        pass


class StatefulWindows:
    """Window stream with late output; ``start`` runs it on a stream of parsed events.

    What it writes is below ``root``, one folder for each ``status``: ``WINDOW``
    (parts of closed windows), ``LATE`` and, with ``keep_events``, ``NORMAL`` (an
    accepted event for each of its open windows).
    """

    def __init__(self, root: str, spec: WindowSpec, lag_ms: int, lanes: int, keep_events: bool = False, parts: int = 4):
        self.root = root.rstrip("/")
        self.spec, self.lag_ms, self.lanes, self.keep_events, self.parts = spec, lag_ms, lanes, keep_events, parts

    def outputs(self, events: DataFrame) -> DataFrame:
        """The stream of all output rows."""
        content = "content" if "content" in events.columns else "cast(null as string) as content"
        timed = events.selectExpr("timestamp_millis(event_ts) as event_time", "bigint(event_ts) as event_ts", "bigint(log_id) as log_id", content)
        timed = timed.where("event_ts is not null").withWatermark("event_time", f"{self.lag_ms + 1} milliseconds")
        # Without the time column Spark keeps rows behind the watermark.
        pairs = assign_windows(timed.drop("event_time"), self.spec)
        pairs = pairs.selectExpr(
            f"{lane_of('log_id', self.lanes)} as task_id",
            "window_end",
            f"pmod(hash(log_id, event_ts), {self.parts}) as part",
            "event_ts",
            "log_id",
            "content",
            f"window_end = {last_window_end(self.spec)} as is_last",
        )
        return pairs.groupBy("task_id", "window_end", "part").transformWithStateInPandas(
            WindowState(self.keep_events), OUTPUT, "Append", "EventTime"
        )

    def start(self, events: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Processes what is available and ends, or runs on with a ``trigger``."""
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        writer = self.outputs(events).writeStream.format("parquet").outputMode("append").partitionBy("status")
        writer = writer.option("path", self.root).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def read(self, spark: SparkSession, status: str) -> DataFrame:
        rows = spark.read.schema(OUTPUT).parquet(self.root)
        return rows.where(F.col("status") == status)

    def late(self, spark: SparkSession) -> DataFrame:
        """Late events with the watermark they met and the time they were processed."""
        return self.read(spark, LATE).drop(*COUNTS)

    def metrics(self, spark: SparkSession) -> DataFrame:
        """Metric rows of all windows closed so far, with the watermark that closed them."""
        rows = self.read(spark, WINDOW).groupBy("task_id", "window_end").agg(
            F.max("sys_ts").alias("trigger_ts"),
            F.sum("count_actual").alias("count_actual"),
            F.min("min_id").alias("min_id"),
            F.max("max_id").alias("max_id"),
            F.max("current_wm").alias("current_wm"),
        )
        key = f"{lane_key('task_id', self.lanes)} as key"
        return id_gaps(rows.selectExpr("*", key, "trigger_ts - window_end as lag_system"), self.lanes)

    def trace(self, spark: SparkSession) -> DataFrame:
        """NORMAL rows of the windows closed so far and all LATE rows (needs ``keep_events``).

        A window is closed once the watermark has passed it, so NORMAL rows need no
        join with the windows: the newest watermark tells which to take.
        """
        newest = self.read(spark, WINDOW).agg(F.max("window_end").alias("newest")).first()["newest"]
        normal = self.read(spark, NORMAL).where(F.lit(newest).isNotNull() & (F.col("window_end") <= F.lit(newest)))
        return normal.unionByName(self.read(spark, LATE)).drop("current_wm", *COUNTS)
