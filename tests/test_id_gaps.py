import random

import pytest

from tidemark.operators.arrival_scan import arrival_scan
from tidemark.operators.id_gaps import exact_gaps, lost_ids, merge_ids, received_ids
from tidemark.operators.windows import sliding, tumbling
from tidemark.session import materialize


@pytest.fixture
def lossy(spark):
    """Ids in the order of the events, some far apart, negative ones too; a fifth is lost, some come twice."""
    rng, rows, given, event = random.Random(31), [], [], 0
    for log_id in [*range(-40, 400), *range(400_000, 400_050)]:
        event += rng.randrange(0, 60)
        given.append(log_id)
        if rng.random() >= 0.2:
            arrival = event + int(rng.lognormvariate(6, 1))
            rows += [(arrival, log_id, event)] * rng.choice([1, 1, 1, 2])
    frame = spark.createDataFrame(rows, "arrival_ts BIGINT, log_id BIGINT, event_ts BIGINT")
    return given, materialize(arrival_scan(frame, 3, bucket_ms=900), "scan")


def test_losses_are_given_minus_received(lossy):
    given, scan = lossy
    spec, lags = tumbling(2000), [1000, 0, 300]
    parts = [received_ids(scan.where(f"arrival_ts % 2 = {k}"), spec, lags, 3) for k in (0, 1)]
    received = materialize(merge_ids(parts[0].unionByName(parts[1])), "received")
    rows, came = scan.collect(), {}
    for r in rows:
        refused = sum(r.seen_ts is not None and r.seen_ts - (r.event_ts - r.event_ts % 2000 + 2000) >= lag for lag in lags)
        came[r.log_id] = min(refused, came.get(r.log_id, 9))
    found = exact_gaps(received, lags, block=5).collect()
    lost = lost_ids(received, 3, block=5).collect()
    for task in range(3):
        ids = sorted(i for i in came if i % 3 == task)
        expected = set(range(ids[0], ids[-1] + 1, 3)) - set(ids)
        assert {i for i in given if ids[0] < i < ids[-1] and i % 3 == task} - set(ids) <= expected
        assert {r.log_id for r in lost if r.task_id == task} == expected
        for k, lag in enumerate(sorted(lags)):
            mine = [r for r in found if (r.task_id, r.lag_ms) == (task, lag)]
            assert sum(r.lost for r in mine) == len(expected) and sum(r.given for r in mine) == len(expected) + len(ids)
            assert sum(r.accepted for r in mine) == sum(came[i] <= k for i in ids)
            assert sum(r.late for r in mine) == sum(came[i] > k for i in ids) and min(r.lost for r in mine) >= 0
    by_window = {}
    for r in lost:
        by_window[r.task_id, r.window_end] = by_window.get((r.task_id, r.window_end), 0) + 1
    assert {(r.task_id, r.window_end): r.lost for r in found if r.lost} == by_window


def test_no_rows_and_sliding_windows(lossy):
    _, scan = lossy
    empty = received_ids(scan.limit(0), tumbling(2000), [0], 3)
    assert exact_gaps(empty, [0]).count() == 0 and lost_ids(empty, 3).count() == 0
    with pytest.raises(ValueError):
        received_ids(scan, sliding(2000, 1000), [0], 3)
