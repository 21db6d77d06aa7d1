import pytest

from tests.test_streaming import CASES, FILES
from tidemark.functions.parse import parse_lines
from tidemark.operators.windows import tumbling
from tidemark.sources.lines import stream_lines
from tidemark.streaming.feed import write_feed
from tidemark.streaming.stateful_windows import StatefulWindows

pytest.importorskip("google.protobuf")


def lines_of(files):
    return [(n, f"{int(t * 1000)},{10 * n + i},c") for n, times in enumerate(files) for i, t in enumerate(times)]


@pytest.fixture
def feed(spark, tmp_path):
    folder = str(tmp_path / "feed")
    write_feed(spark.createDataFrame([*lines_of(FILES), (2, "not a line")], "slice INT, value STRING"), "slice", folder)
    return folder


@pytest.mark.parametrize("kind", CASES)
def test_late_rows_and_windows(spark, feed, tmp_path, kind):
    spec, late, closed = CASES[kind]
    job = StatefulWindows(str(tmp_path / "job"), spec, 0, 1, keep_events=True, parts=2)
    job.start(parse_lines(stream_lines(spark, feed)), str(tmp_path / "checkpoint")).awaitTermination()
    rows = job.late(spark).collect()
    assert sorted(r.log_id for r in rows) == late
    assert {r.log_id: r.current_wm for r in rows}[10] == 3899
    assert {r.window_end: r.count_actual for r in job.metrics(spark).collect()} == closed
    trace = job.trace(spark).collect()
    assert sorted(r.log_id for r in trace if r.status == "LATE") == late
    assert len([r for r in trace if r.status == "NORMAL"]) == sum(closed.values())


def test_a_restart_goes_on_with_its_state(spark, tmp_path):
    """Each file in a run of its own: state, timers and watermark come from the checkpoint."""
    spec, late, closed = CASES["sliding"]
    folder, checkpoint = str(tmp_path / "feed"), str(tmp_path / "checkpoint")
    job = StatefulWindows(str(tmp_path / "job"), spec, 0, 1)
    for n in range(len(FILES)):
        own = [r for r in lines_of(FILES) if r[0] == n]
        write_feed(spark.createDataFrame(own, "slice INT, value STRING"), "slice", str(tmp_path / f"one-{n}"))
        for path in (tmp_path / f"one-{n}").glob("part-*.txt"):
            (tmp_path / "feed").mkdir(exist_ok=True)
            (tmp_path / "feed" / f"{n}-{path.name}").write_bytes(path.read_bytes())
        job.start(parse_lines(stream_lines(spark, folder)), checkpoint).awaitTermination()
    assert sorted(r.log_id for r in job.late(spark).collect()) == late
    assert {r.window_end: r.count_actual for r in job.metrics(spark).collect()} == closed


def test_a_window_closes_at_its_last_millisecond(spark, tmp_path):
    """The watermark 1999 closes the window that ends at 2000, and 1998 does not."""
    for top, want in ((1999, []), (2000, [(2000, 2, 1999)])):
        folder = str(tmp_path / f"feed-{top}")
        write_feed(spark.createDataFrame([(0, "100,0,c"), (0, "1900,1,c"), (1, f"{top},2,c")], "slice INT, value STRING"), "slice", folder)
        job = StatefulWindows(str(tmp_path / f"job-{top}"), tumbling(2000), 0, 1)
        job.start(parse_lines(stream_lines(spark, folder)), str(tmp_path / f"check-{top}")).awaitTermination()
        assert [(r.window_end, r.count_actual, r.current_wm) for r in job.metrics(spark).collect()] == want
