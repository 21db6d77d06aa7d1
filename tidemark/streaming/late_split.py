"""Late output of a stream for all window types and lags at once.

Each micro-batch ``n`` reads the highest event times that batch ``n - 1`` left and
splits off its late events: whether an event is late depends on those alone, not on
the windows, so one stream serves a whole sweep of lags. What a batch writes is
overwritten if it is run again, so a restart after a failure gives the same result.
Windows with their counts come from ``stateful_windows``.

The same holds for the events of a trace: which windows accept an event depends on
those highest event times, and which windows have closed on the newest of them, so a
trace needs no state of windows and its rows are never moved.

Folders below ``root`` have one ``batch_id=<n>`` per batch: ``late`` with its late
events, ``watermark`` with one row and, with ``keep_events``, ``normal`` (an accepted
event for each of its open windows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.parse import lane_of
from tidemark.operators.lateness import closed, late_events_sweep, window_pairs
from tidemark.operators.trace import LATE, NO_WINDOW, NORMAL
from tidemark.operators.windows import Sweep

TOPS = "seen_before BIGINT, tops ARRAY<STRUCT<source: STRING, top: BIGINT>>"
STEP = f"{TOPS}, processed_ts BIGINT"


class LateSplit:
    """``foreachBatch`` handler; ``start`` runs it on a stream of parsed events.

    ``root`` and the checkpoint belong together: begin both anew, or neither. If
    events have a ``source`` (a partition, file or sender), the watermark is the
    minimum over the ``sources`` declared, and there is none before all have sent.
    """

    def __init__(self, root: str, sweep: Sweep, lanes: int, sources: int = 1, keep_events: bool = False):
        self.root, self.sweep, self.lanes, self.sources = root.rstrip("/"), sweep, lanes, sources
        self.keep_events = keep_events

    def start(self, events: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Processes what is available and ends, or runs on with a ``trigger``.

        ``{"processingTime": "10 seconds"}`` is such a trigger.
        """
        writer = events.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.root}/{kind}/batch_id={batch_id}"

    def _tops(self, spark: SparkSession, batch_id: int) -> dict[str, int]:
        """Highest event time of every source seen, after the batch before."""
        if batch_id == 0:
            return {}
        row = spark.read.schema(STEP).parquet(self._folder("watermark", batch_id - 1)).first()
        return {s.source: s.top for s in row.tops}

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tops = self._tops(spark, batch_id)
        seen = min(tops.values()) if len(tops) >= self.sources else None
        source = F.col("source").cast("string") if "source" in batch.columns else F.lit("")
        found = batch.groupBy(source.alias("source")).agg(F.max("event_ts").alias("top")).where("top is not null").collect()
        tops |= {r.source: max(r.top, tops.get(r.source, r.top)) for r in found}
        if len(tops) > self.sources:
            raise ValueError(f"{len(tops)} sources where {self.sources} are declared")

        rows = batch.select("event_ts", "log_id", *[c for c in ("content",) if c in batch.columns])
        rows = rows.withColumn("seen_ts", F.lit(seen).cast("bigint"))
        task = f"{lane_of('log_id', self.lanes)} as task_id"
        late = late_events_sweep(rows, self.sweep).drop("seen_ts")
        late = late.selectExpr(task, "*", f"'{LATE}' as status", f"bigint({NO_WINDOW}) as window_end")
        late.write.mode("overwrite").parquet(self._folder("late", batch_id))
        if self.keep_events:
            normal = self._accepted(rows).selectExpr(task, "*", f"'{NORMAL}' as status")
            normal.write.mode("overwrite").parquet(self._folder("normal", batch_id))
        after = spark.createDataFrame([(seen, sorted(tops.items()))], TOPS)
        after = after.withColumn("processed_ts", F.expr("unix_millis(current_timestamp())"))
        after.write.mode("overwrite").parquet(self._folder("watermark", batch_id))

    def _accepted(self, rows: DataFrame) -> DataFrame:
        """The events once for each window type, lag and window that accepts them."""
        found = []
        for spec, lags in self.sweep:
            accepting = ", ".join(f"if({closed(lag)}, null, {lag}L)" for lag in sorted(set(lags)))
            pairs = window_pairs(rows, spec).selectExpr("*", f"'{spec.kind}' as window_type", f"explode(array({accepting})) as lag_ms")
            found.append(pairs.where("lag_ms is not null").drop("seen_ts", "overrun"))
        return reduce(DataFrame.unionByName, found)

    def trace(self, spark: SparkSession) -> DataFrame:
        """NORMAL rows of the windows closed so far and all LATE rows (needs ``keep_events``)."""
        late, normal = (spark.read.parquet(f"{self.root}/{kind}") for kind in ("late", "normal"))
        steps = spark.read.parquet(f"{self.root}/watermark")
        tops = steps.orderBy(F.desc("batch_id")).first()["tops"]
        seen = min(s.top for s in tops) if tops and len(tops) >= self.sources else None
        normal = normal.withColumn("overrun", F.lit(seen).cast("bigint") - F.col("window_end")).where(closed("lag_ms"))
        return normal.drop("overrun", "batch_id").unionByName(late.drop("batch_id"))

    def late(self, spark: SparkSession) -> DataFrame:
        """Late events of every window type and lag, with the watermark they met and the time they were processed."""
        late, steps = (spark.read.parquet(f"{self.root}/{kind}") for kind in ("late", "watermark"))
        rows = late.join(steps.selectExpr("batch_id", "seen_before", "processed_ts as sys_ts"), "batch_id")
        return rows.withColumn("current_wm", F.expr("seen_before - lag_ms - 1")).drop("seen_before")
