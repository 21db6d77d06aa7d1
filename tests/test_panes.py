import pytest

from tests.model import StreamJob
from tests.test_windows_and_watermarks import disorderly, rows_of
from tidemark.operators import panes
from tidemark.operators.arrival_scan import arrival_scan
from tidemark.operators.lateness import window_pairs
from tidemark.operators.window_metrics import window_metrics
from tidemark.operators.windows import WindowSpec, sliding
from tidemark.session import materialize

SPECS = [sliding(2000, 1000), sliding(2500, 1000), sliding(6000, 100), sliding(3700, 250), sliding(1001, 1000), sliding(9000, 1000)]


@pytest.mark.parametrize("spec", SPECS, ids=str)
@pytest.mark.parametrize("listed", [1, 1000], ids=["nodes", "listed"])
def test_counts_match_pairs_of_events_and_windows(log, spec, listed):
    frame = log([*disorderly(400, 6), (9_000_000, 8_999_000), (9_000_100, -8_999_000), (9_000_200, 8_990_000)])
    scan = materialize(arrival_scan(frame, 3, bucket_ms=1500), "scan")
    lags = [0, 500, 1300]
    found = {}
    for r in window_pairs(scan, spec).collect():
        refused = sum(r.overrun is not None and r.overrun >= lag for lag in lags)
        if refused < len(lags):
            key = (r.log_id % 3, r.window_end, refused)
            n, low, high, wait = found.get(key, (0, r.log_id, r.log_id, 0))
            found[key] = (n + 1, min(low, r.log_id), max(high, r.log_id), wait + r.window_end - r.event_ts)
    got = panes.sliding_counts(scan, spec, lags, 3, listed=listed).collect()
    assert {(r.task_id, r.window_end, r.refused_by): (r.n, r.low, r.high, r.wait) for r in got} == found
    assert len(got) == len(found)
    ends = [r.window_end for r in panes.window_ends_of(scan, spec).collect()]
    assert sorted(ends) == sorted({r.window_end for r in window_pairs(scan, spec).select("window_end").collect()})


def test_metrics_of_many_windows_match_row_by_row_job(log):
    frame, spec = log(disorderly(300, 8)), sliding(6000, 100)
    scan = materialize(arrival_scan(frame, 3, bucket_ms=1500), "scan")
    metrics = window_metrics(scan, [(spec, [0, 700])], 3).collect()
    for lag in (0, 700):
        job = StreamJob(6000, 100, lag, 3).run(rows_of(frame))
        got = [(r.task_id, r.window_end, r.trigger_ts, r.count_actual, r.count_expected, r.current_wm) for r in metrics if r.lag_ms == lag]
        assert sorted(job.metrics) == sorted(got)


def test_counts_by_source_with_null_sources(spark, log):
    frame = log(disorderly(200, 7)).selectExpr("*", "case log_id % 3 when 0 then 'a' when 1 then 'b' end as source")
    scan = materialize(arrival_scan(frame, 2, by=("source",), bucket_ms=700), "scan")
    spec = WindowSpec("sliding", 3000, 200)
    got = panes.sliding_counts(scan, spec, [0], 2, by=("source",), listed=1)
    assert got.selectExpr("sum(n)").first()[0] == window_pairs(scan, spec).where("overrun is null or overrun < 0").count()
    assert got.select("source").distinct().count() == 3


def test_shuffled_rows_do_not_grow_with_the_windows_of_an_event(log):
    """Events reach the first exchange unmultiplied, and what leaves it is as much for 60 windows as for 2."""
    scan = materialize(arrival_scan(log(disorderly(2000, 9)), 3, bucket_ms=5000), "scan")
    counts = [panes.pane_counts(scan, sliding(k * 1000, 1000), [100_000], 3, []) for k in (2, 60)]
    assert counts[0].count() == counts[1].count() < 2000
    plan = counts[1]._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Generate" not in plan
