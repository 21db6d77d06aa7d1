import pytest

from tidemark.functions.parse import parse_lines
from tidemark.operators.windows import sliding, tumbling
from tidemark.sources.lines import read_lines, stream_lines
from tidemark.streaming.feed import write_feed
from tidemark.streaming.late_split import LateSplit
from tidemark.streaming.native import start_native, window_stream

# Event times (s) per file; ids are 10 * file + position.
FILES = [[0.5, 1.0, 3.9], [1.2, 4.1], [1.3, 3.0, 4.5], [1.4, 9.0], [4.2, 9.5]]


@pytest.fixture
def feed(spark, tmp_path):
    rows = [(n, f"{int(t * 1000)},{10 * n + i},c") for n, times in enumerate(FILES) for i, t in enumerate(times)]
    rows.append((2, "not a line"))
    folder = str(tmp_path / "feed")
    assert write_feed(spark.createDataFrame(rows, "slice INT, value STRING"), "slice", folder) == 1
    assert read_lines(spark, folder).count() == len(rows)
    return folder


def test_native_windows(spark, feed, tmp_path):
    metrics = window_stream(parse_lines(stream_lines(spark, feed)), tumbling(2000), 0, 1)
    output = str(tmp_path / "out")
    start_native(metrics, output, str(tmp_path / "checkpoint")).awaitTermination()
    got = {r.window_end: r.count_actual for r in spark.read.schema(metrics.schema).parquet(output).collect()}
    assert got == {2000: 3, 4000: 2, 6000: 3}


CASES = {
    "tumbling": (tumbling(2000), [10, 20, 21, 30, 40], {2000: 2, 4000: 1, 6000: 2}),
    "sliding": (sliding(2000, 1000), [10, 20, 30, 40], {1000: 1, 2000: 2, 3000: 1, 4000: 1, 5000: 4, 6000: 2}),
}


def test_late_split_of_a_sweep(spark, feed, tmp_path):
    sweep = [(spec, [0, 60_000]) for spec, _, _ in CASES.values()]
    job = LateSplit(str(tmp_path / "job"), sweep, 1)
    job.start(parse_lines(stream_lines(spark, feed)), str(tmp_path / "checkpoint")).awaitTermination()
    rows = job.late(spark).collect()
    for kind, (_, late, _) in CASES.items():
        assert sorted(r.log_id for r in rows if r.window_type == kind and r.lag_ms == 0) == late
    assert not [r for r in rows if r.lag_ms]
    assert {r.log_id: r.current_wm for r in rows}[10] == 3899


def test_trace_of_a_sweep_from_the_watermarks_alone(spark, feed, tmp_path, monkeypatch):
    """Nothing is closed for a lag of a minute; a batch that is run again writes the same."""
    sweep = [(spec, [0, 60_000]) for spec, _, _ in CASES.values()]
    monkeypatch.setattr(FailsOnce, "failed", False)
    job, lines = FailsOnce(str(tmp_path / "job"), sweep, 1, keep_events=True), parse_lines(stream_lines(spark, feed))
    with pytest.raises(Exception, match="lost"):
        job.start(lines, str(tmp_path / "checkpoint")).awaitTermination()
    job.start(lines, str(tmp_path / "checkpoint")).awaitTermination()
    rows = job.trace(spark).collect()
    for kind, (_, late, closed) in CASES.items():
        own = [r for r in rows if r.window_type == kind and r.lag_ms == 0]
        assert sorted(r.log_id for r in own if r.status == "LATE") == late
        ends = [r.window_end for r in own if r.status == "NORMAL"]
        assert {end: ends.count(end) for end in ends} == closed
    assert not [r for r in rows if r.lag_ms]
    open_rows = spark.read.parquet(str(tmp_path / "job" / "normal")).where("lag_ms = 60000")
    events = sum(map(len, FILES))
    assert open_rows.count() == events + 2 * events


class FailsOnce(LateSplit):
    """Fails in batch 2 after everything is written, before the batch is committed."""

    failed = False

    def process(self, batch, batch_id):
        super().process(batch, batch_id)
        if batch_id == 2 and not FailsOnce.failed:
            FailsOnce.failed = True
            raise RuntimeError("lost")


def test_late_split_survives_a_restart(spark, feed, tmp_path):
    spec, late, _ = CASES["sliding"]
    checkpoint = str(tmp_path / "checkpoint")
    job = FailsOnce(str(tmp_path / "job"), [(spec, [0])], 1)
    with pytest.raises(Exception, match="lost"):
        job.start(parse_lines(stream_lines(spark, feed)), checkpoint).awaitTermination()
    job.start(parse_lines(stream_lines(spark, feed)), checkpoint).awaitTermination()
    assert sorted(r.log_id for r in job.late(spark).collect()) == late


def batches(spark, folder, files, tmp_path):
    """The lines of every micro-batch of a feed."""
    found = {}

    def take(batch, number):
        found[number] = sorted(r.value for r in batch.collect())

    writer = stream_lines(spark, folder, files).writeStream.foreachBatch(take)
    writer.option("checkpointLocation", str(tmp_path / "feed-check")).trigger(availableNow=True).start().awaitTermination()
    return [found[k] for k in sorted(found)]


def test_feed_keeps_every_row_and_one_batch_a_slice(spark, tmp_path):
    sizes = {None: 3, -7: 25, 4: 1, 5: 11, 900: 40}
    rows = [(s, f"{s}-{k}") for s, n in sizes.items() for k in range(n)]
    folder = str(tmp_path / "uneven")
    files = write_feed(spark.createDataFrame(rows, "slice INT, value STRING").repartition(3), "slice", folder, rows_per_file=10)
    assert files == 4
    assert batches(spark, folder, files, tmp_path) == [sorted(v for s, v in rows if s == own) for own in sizes]


def test_feed_reports_rows_that_do_not_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(0, "one"), (0, "two\nlines")], "slice INT, value STRING")
    with pytest.raises(ValueError, match="3 of 2"):
        write_feed(rows, "slice", str(tmp_path / "broken"))
    assert write_feed(rows.limit(0), "slice", str(tmp_path / "none")) == 1


def test_watermark_is_the_minimum_over_sources(spark, tmp_path):
    job = LateSplit(str(tmp_path / "job"), [(tumbling(1000), [0])], 1, sources=2)
    schema = "event_ts BIGINT, log_id BIGINT, content STRING, source STRING"
    steps = [[(5000, 1, "c", "a")], [(1000, 2, "c", "b")], [(900, 3, "c", "a")], [(9000, 4, "c", "b")], [(3000, 5, "c", "a")]]
    for n, rows in enumerate(steps):
        job.process(spark.createDataFrame(rows, schema), n)
    # No watermark before both have sent, then 1000 and, from batch 3 on, 5000.
    assert [(r.log_id, r.current_wm) for r in job.late(spark).orderBy("log_id").collect()] == [(3, 999), (5, 4999)]
    with pytest.raises(ValueError, match="declared"):
        job.process(spark.createDataFrame([(1, 1, "c", "third")], schema), 5)


def test_a_stream_runs_until_it_is_stopped(spark, feed, tmp_path):
    metrics = window_stream(parse_lines(stream_lines(spark, feed)), tumbling(2000), 0, 1, run={"run_id": "'r1'"})
    query = start_native(metrics, str(tmp_path / "out"), str(tmp_path / "checkpoint"), {"processingTime": "0 seconds"})
    try:
        query.processAllAvailable()
        assert query.isActive
    finally:
        query.stop()
    rows = spark.read.schema(metrics.schema).parquet(str(tmp_path / "out")).collect()
    assert {r.window_end: r.count_actual for r in rows} == {2000: 3, 4000: 2, 6000: 3} and {r.run_id for r in rows} == {"r1"}
