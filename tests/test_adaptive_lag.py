import pytest

from tests.test_windows_and_watermarks import disorderly
from tidemark.operators.adaptive_lag import adaptive_scan, beside_fixed, disorder_by_horizon, following_lags
from tidemark.operators.arrival_scan import arrival_scan
from tidemark.operators.lateness import drop_rates
from tidemark.operators.windows import tumbling

HORIZON = 900


def job(rows, lanes, per_mille, first):
    """Row by row: disorder of each horizon, lags, and the watermark plus one after each row."""
    top, by_horizon = None, {}
    for arrival, _, event in sorted(rows):
        top = event if top is None else max(top, event)
        by_horizon.setdefault(arrival // HORIZON, []).append(top - event)
    worst = {h: sorted(x)[-(-per_mille * len(x) // 1000) - 1] for h, x in by_horizon.items()}
    order = sorted(worst)
    lags = {h: first if k == 0 else worst[order[k - 1]] for k, h in enumerate(order)}
    tops, seen = [None] * lanes, {}
    for turn, (arrival, log_id, event) in enumerate(sorted(rows)):
        shifted, lane = event - lags[arrival // HORIZON], turn % lanes
        tops[lane] = shifted if tops[lane] is None else max(tops[lane], shifted)
        seen[log_id] = None if None in tops else min(tops)
    return lags, seen


@pytest.mark.parametrize("lanes", [1, 3])
@pytest.mark.parametrize("per_mille", [500, 990, 1000])
def test_watermark_follows_the_disorder(log, lanes, per_mille):
    pairs = disorderly(400, 31)
    frame = log(pairs).drop("content")
    lags = following_lags(disorder_by_horizon(arrival_scan(frame, bucket_ms=700), HORIZON, per_mille=per_mille), 77)
    want, seen = job([(a, i, e) for i, (a, e) in enumerate(pairs)], lanes, per_mille, 77)
    assert {r.horizon: r.lag_ms for r in lags.collect()} == want
    rows = adaptive_scan(frame, lags, HORIZON, lanes, bucket_ms=700).collect()
    assert {r.log_id: r.seen_ts for r in rows} == seen
    assert {r.log_id: r.event_ts for r in rows} == {i: e for i, (_, e) in enumerate(pairs)}
    ordered = [r.seen_ts for r in sorted(rows, key=lambda r: (r.arrival_ts, r.log_id)) if r.seen_ts is not None]
    assert ordered == sorted(ordered)


def test_a_constant_lag_is_the_fixed_one(spark, log):
    frame = log(disorderly(300, 32)).drop("content")
    lags = frame.selectExpr(f"arrival_ts div {HORIZON} as horizon", "150L as lag_ms").distinct()
    ours = drop_rates(adaptive_scan(frame, lags, HORIZON, 3, bucket_ms=700), [tumbling(100)], [0]).drop("lag_ms").collect()
    theirs = drop_rates(arrival_scan(frame, 3, bucket_ms=700), [tumbling(100)], [150]).drop("lag_ms").collect()
    assert ours == theirs and ours[0].late > 0


def test_sources_nulls_and_empty_logs(spark, log):
    frame = log(disorderly(200, 33)).selectExpr("arrival_ts", "log_id", "if(log_id % 9 = 0, null, event_ts) as event_ts", "if(log_id % 2 = 0, null, 'a') as source")
    by = ("source",)
    lags = following_lags(disorder_by_horizon(arrival_scan(frame, by=by, bucket_ms=700), HORIZON, by), 5, by, least_lag_ms=3)
    both = adaptive_scan(frame, lags, HORIZON, by=by, bucket_ms=700).collect()
    assert len(both) == 200 and {r.source for r in lags.collect()} == {None, "a"} and min(r.lag_ms for r in lags.collect()) >= 3
    one = frame.where("source = 'a'").drop("source")
    alone = following_lags(disorder_by_horizon(arrival_scan(one, bucket_ms=700), HORIZON), 5, least_lag_ms=3)
    assert {r.log_id: r.seen_ts for r in adaptive_scan(one, alone, HORIZON, bucket_ms=700).collect()} == {r.log_id: r.seen_ts for r in both if r.source}
    nothing = frame.limit(0)
    assert disorder_by_horizon(arrival_scan(nothing, by=by, bucket_ms=700), HORIZON, by).count() == 0
    assert adaptive_scan(nothing, lags, HORIZON, by=by, bucket_ms=700).count() == 0
    with pytest.raises(ValueError):
        disorder_by_horizon(nothing, HORIZON, per_mille=0)


def test_best_fixed_lag_drops_no_more(spark):
    columns = "window_type STRING, lag_ms BIGINT, lag_s DOUBLE, drop_rate DOUBLE, avg_latency_s DOUBLE, avg_trigger_delay_s DOUBLE"
    ours = spark.createDataFrame([("t", 0, 0.0, 0.02, 4.0, 1.0), ("s", 0, 0.0, 0.01, 4.0, 1.0)], columns)
    fixed = spark.createDataFrame([("t", 1, 1.0, 0.05, 3.0, 1.0), ("t", 2, 2.0, 0.02, 5.0, 1.0), ("t", 3, 3.0, 0.0, 6.0, 1.0), ("s", 9, 9.0, 0.5, 6.0, 1.0)], columns)
    lags = spark.createDataFrame([(0, 30, 1000), (1, 10, 3000)], "horizon BIGINT, rows BIGINT, lag_ms BIGINT")
    found = {r.window_type: r for r in beside_fixed(ours, fixed, lags).collect()}
    assert found["t"].fixed_lag_s == 2.0 and found["t"].mean_lag_s == 1.5 and found["s"].fixed_lag_s is None
