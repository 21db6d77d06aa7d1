import random

import pandas as pd
import pytest

from tidemark.operators import calibrate, disorder, series
from tidemark.operators.arrival_scan import arrival_scan
from tidemark.plans.tradeoff import replay_sweep, sweet_spot, tradeoff_table
from tidemark.operators.windows import sliding, tumbling


def totals(spark, rows):
    return spark.createDataFrame(rows, "run STRING, sys_ts BIGINT, processed BIGINT, late BIGINT, delay_ms BIGINT")


def pandas_series(rows, cutoff_s):
    """The published arithmetic, row by row over a dense second grid."""
    last = max(r[1] for r in rows)
    kept = [r for r in rows if r[1] <= last - cutoff_s * 1000]
    start = min(r[1] for r in kept)
    table = pd.DataFrame([((r[1] - start) // 1000, r[2] + r[3], r[2], r[3], r[4] / 1000) for r in kept])
    table = table.groupby(0).sum()
    table = table.reindex(range(table.index.max() + 1), fill_value=0)
    near = table.rolling(5, min_periods=1, center=True)
    out = pd.DataFrame({"throughput": near.mean()[1], "processed_count": near.mean()[2]})
    out["drop_rate"] = (table[3].cumsum() / table[1].cumsum().replace(0, float("nan"))).fillna(0)
    sums = near.sum()
    out["avg_delay_processed"] = (sums[4] / sums[2].replace(0, float("nan"))).fillna(0)
    return out


@pytest.mark.parametrize("block", [2, 1000])
def test_series_matches_pandas(spark, block):
    rng = random.Random(11)
    rows = []
    for run in ("a", "b"):
        for ts in sorted(rng.sample(range(5_000, 60_000), 60)):
            p, late = rng.randrange(4), rng.randrange(2)
            rows.append((run, ts, p, late, p * rng.randrange(900)))
    got = series.run_series(totals(spark, rows), ["run"], 10, block=block).toPandas()
    for run in ("a", "b"):
        mine = got[got.run == run].sort_values("relative_time_s").reset_index(drop=True)
        theirs = pandas_series([r for r in rows if r[0] == run], 10)
        assert list(mine.relative_time_s) == list(theirs.index)
        for column in theirs:
            assert mine[column].tolist() == pytest.approx(theirs[column].tolist())
        # The last cumulative drop rate is the drop rate of the summary.
        summary = series.run_summary(totals(spark, rows), ["run"], 10).where(f"run = '{run}'").first()
        assert mine.drop_rate.iloc[-1] == pytest.approx(summary.drop_rate)
        assert summary.rows == summary.processed + summary.late


def test_rolling_edges(spark):
    rows = [("a", 1000 * i, i + 1, 0, 0) for i in range(6)]
    got = series.run_series(totals(spark, rows), ["run"], 0).orderBy("relative_time_s").collect()
    assert [r.throughput for r in got] == [2, 2.5, 3, 4, 4.5, 5]


def test_tail_cut_can_leave_nothing(spark):
    rows = totals(spark, [("a", 1000, 1, 0, 5), ("b", 1000, 1, 0, 5), ("b", 50_000, 1, 0, 5)])
    assert [r.run for r in series.run_summary(rows, ["run"], 10).collect()] == ["b"]


def test_window_summary(spark):
    rows = [("a", 2000, 2500), ("a", 2000, 2500), ("a", 4000, 5000), ("a", 6000, 60_000)]
    metrics = spark.createDataFrame(rows, "run STRING, window_end BIGINT, trigger_ts BIGINT")
    got = series.window_summary(metrics, ["run"], 10).first()
    assert (got.windows, got.avg_trigger_delay_s) == (3, pytest.approx((0.5 + 0.5 + 1.0) / 3))


def test_calibration(spark):
    rows = [
        ("r", 0, 1000, 3050, 2000), ("r", 0, 1000, 4300, 3000), ("r", 0, 1000, 9000, -1),
        ("r", 1, 1000, 3095, 2000), ("r", 1, 1000, 4300, 3000),
        ("r", 2, 1000, 5000, -1),
        ("s", 0, None, 3050, 2000),
    ]
    layout = "run STRING, task_id INT, lag_ms BIGINT, {ts} BIGINT, window_end BIGINT"
    trace = spark.createDataFrame(rows, layout.format(ts="sys_ts"))
    got = [tuple(r) for r in calibrate.calibrate(trace, ["run", "task_id"]).orderBy("run", "task_id", "sys_ts").select("sys_ts").collect()]
    assert [t for (t,) in got] == [3100, 4350, 9050, 3095, 4300, 5000, 3050]
    metrics = spark.createDataFrame(rows[:2], layout.format(ts="trigger_ts"))
    got = calibrate.calibrate(metrics, ["run", "task_id"]).orderBy("trigger_ts").collect()
    assert [(r.trigger_ts, r.lag_system) for r in got] == [(3100, 1100), (4350, 1350)]
    offsets = calibrate.clock_offsets(trace, ["run", "task_id"], "sys_ts").orderBy("task_id").collect()
    assert [(r.offset_ms, r.applied_ms) for r in offsets] == [(50, 50), (5, 0)]
    with pytest.raises(ValueError):
        calibrate.calibrate(spark.range(1), ["id"])


def with_delay(frame):
    return frame.selectExpr("*", "arrival_ts - event_ts as delay_ms")


def test_density_starts_at_first_arrival(spark, log):
    frame = with_delay(log([(700, 0), (1600, 0), (1800, 0), (4900, 0)]))
    got = disorder.traffic_density(frame, [], block=2).orderBy("second").collect()
    assert [(r.second, r.n) for r in got] == [(0, 2), (1, 1), (2, 0), (3, 0), (4, 1)]


def test_loss_curve_counts_strictly_above(log):
    # Disorder 0, 0, 1000, 5000: only thresholds below the disorder lose the row.
    frame = log([(0, 0), (1, 6000), (2, 5000), (3, 1000)])
    scan = arrival_scan(frame, 1, bucket_ms=2)
    curve = disorder.lag_loss_curve(scan, []).orderBy("threshold_no").collect()
    expected = [sum(lag > i * 5000 / 49 for lag in (0, 0, 1000, 5000)) for i in range(50)]
    assert [r.dropped for r in curve] == expected
    assert curve[0].loss_percent == 50.0 and curve[49].loss_percent == 0.0


def test_loss_targets_take_the_first_of_equals(spark):
    rows = [(i, i * 1.0, p) for i, p in enumerate((9.0, 6.0, 4.0, 1.5, 0.5, 0.5))]
    curve = spark.createDataFrame(rows, "threshold_no BIGINT, threshold_s DOUBLE, loss_percent DOUBLE")
    got = {r.target_percent: r.threshold_s for r in disorder.loss_targets(curve, []).collect()}
    assert got == {1.0: 3.0, 5.0: 1.0}


def test_histogram_closes_last_bin_and_handles_one_value(spark, log):
    frame = with_delay(log([(a, 0) for a in (0, 1, 49, 50, 100)]))
    got = {r.bin: r.n for r in disorder.delay_histogram(frame, []).collect()}
    assert (len(got), sum(got.values()), got[49], got[0], got[25]) == (50, 5, 1, 2, 1)
    same = with_delay(log([(5, 0), (5, 0)]))
    assert sum(r.n for r in disorder.delay_histogram(same, []).collect()) == 2


def test_statistics(log):
    frame = with_delay(log([(1000, 0), (3500, 500), (2600, 2500)]))
    row = disorder.replay_stats(frame, []).first()
    assert tuple(row) == (3, 3.5, pytest.approx(4.1 / 3), 3.0)
    assert disorder.delay_summary(frame, []).first().share_over_2s == pytest.approx(1 / 3)
    stats = disorder.disorder_stats(arrival_scan(frame, 1, bucket_ms=10), []).first()
    assert (stats.rows, stats.out_of_order, stats.max_lag_s) == (3, 1, 2.0)


def test_tradeoff_and_sweet_spot(log):
    rng = random.Random(3)
    pairs = [(t * 20 + int(rng.lognormvariate(6, 0.8)), t * 20) for t in range(3000)]
    scan = arrival_scan(log(pairs), 3, bucket_ms=5000)
    sweep = [(tumbling(2000), [0, 1000, 4000]), (sliding(2000, 1000), [0, 1000])]
    metrics, totals_ = replay_sweep(scan, sweep, 3)
    table = tradeoff_table(totals_, metrics, cutoff_s=5)
    rows = table.collect()
    assert [(r.lag_ms, r.window_type) for r in rows] == [
        (0, "sliding"), (0, "tumbling"), (1000, "sliding"), (1000, "tumbling"), (4000, "tumbling"),
    ]
    tumbling_rows = [r for r in rows if r.window_type == "tumbling"]
    assert [r.drop_rate for r in tumbling_rows] == sorted([r.drop_rate for r in tumbling_rows], reverse=True)
    for row in tumbling_rows:
        # Half a window of waiting on top of the trigger latency.
        assert row.avg_latency_s == pytest.approx(row.avg_trigger_delay_s + 1.0, abs=0.15)
        assert row.avg_trigger_delay_s > row.lag_s
    best = {r.window_type: r.lag_s for r in sweet_spot(table, 0.02).collect()}
    good = min(r.lag_s for r in tumbling_rows if r.drop_rate <= 0.02)
    assert best["tumbling"] == good
