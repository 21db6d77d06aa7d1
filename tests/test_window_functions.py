import statistics

import pytest

from tests.model import StreamJob
from tests.test_windows_and_watermarks import disorderly, rows_of
from tidemark.operators.arrival_scan import arrival_scan
from tidemark.operators.window_functions import COUNT, ID_GAPS, WindowFunction, apply_functions, spread_of
from tidemark.operators.windows import sliding, tumbling
from tidemark.session import materialize

LATEST = WindowFunction({"_last": "max(struct(event_ts, content))"}, {"_last": "max(_last)"}, {"latest": "_last.content"})


@pytest.mark.parametrize("spec, listed", [(tumbling(2000), 8), (sliding(2500, 1000), 8), (sliding(3000, 100), 1)], ids=str)
def test_functions_match_the_elements_of_each_window(log, spec, listed):
    frame = log(disorderly(300, 41))
    scan = materialize(arrival_scan(frame, 3, bucket_ms=1500), "scan")
    functions = [COUNT, ID_GAPS, spread_of("arrival_ts - event_ts", "delay"), LATEST]
    got = {(r.lag_ms, r.task_id, r.window_end): r for r in apply_functions(scan, spec, [0, 700], 3, functions, listed=listed).collect()}
    rows, seen = {r.log_id: r for r in frame.collect()}, 0
    for lag in (0, 700):
        job = StreamJob(spec.size_ms, spec.slide_ms, lag, 3).run(rows_of(frame))
        held = {}
        for _, log_id, status, end in job.trace:
            if status == "NORMAL":
                held.setdefault((log_id % 3, end), []).append(rows[log_id])
        for task, end, trigger, count, expected, wm in job.metrics:
            r, events = got[lag, task, end], held[task, end]
            delays = [e.arrival_ts - e.event_ts for e in events]
            assert (r.trigger_ts, r.count_actual, r.count_expected, r.loss_network, r.current_wm) == (trigger, count, expected, expected - count, wm)
            assert r.mean_delay == pytest.approx(statistics.fmean(delays)) and r.variance_delay == pytest.approx(statistics.pvariance(delays))
            assert r.latest == max((e.event_ts, e.content) for e in events)[1] and r.key == task * 1001
            seen += 1
    assert seen == len(got)


def test_bad_functions_are_refused(log):
    with pytest.raises(ValueError):
        WindowFunction({"a": "count(*)"}, {"b": "sum(a)"})
    with pytest.raises(ValueError):
        WindowFunction({"w": "count(*)"}, {"w": "sum(w)"})
    scan = arrival_scan(log([(1, 0)]), 1, bucket_ms=10)
    with pytest.raises(ValueError):
        apply_functions(scan, tumbling(10), [0], 1, [COUNT, COUNT])
    assert apply_functions(arrival_scan(log([]), 1, bucket_ms=10), tumbling(10), [0], 1, [COUNT]).count() == 0
