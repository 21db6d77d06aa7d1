import random

import pytest

from tests.model import StreamJob
from tidemark.operators import prefix
from tidemark.operators.arrival_scan import DISORDER_MS, arrival_scan, narrower_width, range_bucket_count
from tidemark.operators.firing import slot_grids
from tidemark.operators.lateness import drop_rates, late_events, late_events_sweep, partial_misses
from tidemark.operators.trace import replay_totals, trace_rows, trace_totals
from tidemark.operators.window_metrics import window_firing, window_metrics
from tidemark.operators.windows import WindowSpec, assign_windows, sliding, tumbling
from tidemark.session import materialize


def disorderly(n, seed, burst=False):
    """(arrival, event) pairs with long-tailed delays; a burst puts most rows on one arrival time."""
    rng = random.Random(seed)
    event, pairs = 100_000, []
    for _ in range(n):
        event += rng.randrange(0, 60)
        arrival = event + int(rng.lognormvariate(6, 1))
        pairs.append((130_000 if burst and rng.random() < 0.6 else arrival, event))
    return pairs


def rows_of(log):
    return [(r.arrival_ts, r.log_id, r.event_ts) for r in log.collect()]


@pytest.mark.parametrize("lanes", [1, 3])
@pytest.mark.parametrize(
    "options",
    [{"bucket_ms": 50}, {"bucket_ms": 1000}, {"bucket_ms": 10**9}, {"rows_per_bucket": 40}, {"bucket_ms": 1000, "hot_rows": 1, "rows_per_bucket": 50}],
    ids=str,
)
def test_scan_matches_row_by_row_job(log, lanes, options):
    frame = log(disorderly(400, 1, burst="hot_rows" in options))
    expected = StreamJob(2000, 2000, 0, lanes).run(rows_of(frame)).seen
    got = {r.log_id: r.seen_ts for r in arrival_scan(frame, lanes, **options).collect()}
    assert got == expected


def test_scan_spreads_copies_over_buckets(spark, log):
    """A third of the rows are copies of one row: range buckets still split them."""
    copies = [(150_000, 149_000)] * 300
    frame = log(disorderly(600, 2))
    same = spark.createDataFrame([(a, 77, e, "copy") for a, e in copies], frame.schema)
    frame = frame.unionByName(same).repartition(6)
    scan = arrival_scan(frame, 3, bucket_ms=1000, hot_rows=50, rows_per_bucket=60)
    ordered = sorted((r.arrival_ts, r.log_id, r.event_ts) for r in frame.collect())
    tops, expected = [None] * 3, []
    for turn, row in enumerate(ordered):
        lane = turn % 3
        tops[lane] = row[2] if tops[lane] is None else max(tops[lane], row[2])
        expected.append((*row, -1 if None in tops else min(tops)))
    got = [(r.arrival_ts, r.log_id, r.event_ts, -1 if r.seen_ts is None else r.seen_ts) for r in scan.collect()]
    assert sorted(got) == sorted(expected)


def test_scan_keeps_sources_apart_and_null_keys(spark, log):
    frame = log(disorderly(300, 3))
    frame = frame.selectExpr("*", "case log_id % 3 when 0 then 'a' when 1 then 'b' end as source")
    got = arrival_scan(frame, 2, by=("source",), bucket_ms=700).collect()
    assert len(got) == 300
    for name in ("a", "b", None):
        rows = [(r.arrival_ts, r.log_id, r.event_ts) for r in got if r.source == name]
        expected = StreamJob(2000, 2000, 0, 2).run(rows).seen
        assert {r.log_id: r.seen_ts for r in got if r.source == name} == expected


def test_scan_of_rows_without_event_time(spark):
    rows = [(1, 0, 10), (2, 1, None), (3, 2, 12), (4, 3, 11)]
    frame = spark.createDataFrame(rows, "arrival_ts BIGINT, log_id BIGINT, event_ts BIGINT")
    got = {r.log_id: r.seen_ts for r in arrival_scan(frame, 2, bucket_ms=2).collect()}
    # Lane 1 gets the row without time and starts with the last row only.
    assert got == {0: None, 1: None, 2: None, 3: 11}


def test_empty_log(log):
    scan = arrival_scan(log([]), 3, bucket_ms=1000)
    assert scan.count() == 0
    assert window_metrics(scan, [(tumbling(2000), [0])], 3).count() == 0


SWEEPS = [
    [(tumbling(2000), [0, 500, 1000, 1500, 3000])],
    [(tumbling(2000), [0, 500]), (sliding(2000, 1000), [0, 700])],
    [(sliding(2500, 1000), [0, 1])],
    [(tumbling(2000), [0, 333])],
]


@pytest.mark.parametrize("sweep", SWEEPS, ids=str)
@pytest.mark.parametrize("lanes", [1, 3])
def test_windows_match_row_by_row_job(log, sweep, lanes):
    frame = log(disorderly(500, 4))
    scan = materialize(arrival_scan(frame, lanes, bucket_ms=1500), "scan")
    metrics = materialize(window_metrics(scan, sweep, lanes, block=3), "metrics")
    trace = materialize(trace_rows(scan, sweep, lanes, block=3), "trace")
    for spec, lags in sweep:
        for lag in lags:
            job = StreamJob(spec.size_ms, spec.slide_ms, lag, lanes).run(rows_of(frame))
            this = f"window_type = '{spec.kind}' and lag_ms = {lag}"
            got = metrics.where(this).collect()
            assert sorted(job.metrics) == sorted(
                (r.task_id, r.window_end, r.trigger_ts, r.count_actual, r.count_expected, r.current_wm) for r in got
            )
            got = trace.where(this).collect()
            assert sorted(job.trace) == sorted((r.sys_ts, r.log_id, r.status, r.window_end) for r in got)
    totals = replay_totals(scan, metrics, sweep)
    columns = ["window_type", "lag_ms", "sys_ts", "processed", "late", "delay_ms"]
    direct = trace_totals(trace, ["window_type", "lag_ms"])
    assert sorted(totals.select(columns).collect()) == sorted(direct.select(columns).collect())


def test_drop_rates_are_consistent(log):
    frame = log(disorderly(800, 5))
    scan = arrival_scan(frame, 3, bucket_ms=2000)
    lags = [0, 200, 500, 1000, 2000, 100_000]
    rates = drop_rates(scan, [tumbling(2000), sliding(2000, 1000)], lags).collect()
    by_kind = {k: [r for r in rates if r.window_type == k] for k in ("tumbling", "sliding")}
    for rows in by_kind.values():
        late = [r.late for r in sorted(rows, key=lambda r: r.lag_ms)]
        assert late == sorted(late, reverse=True) and late[-1] == 0 and late[0] > 0
    for one, two in zip(by_kind["tumbling"], by_kind["sliding"]):
        assert two.late <= one.late
    late0 = late_events(scan, tumbling(2000), 0).count()
    assert late0 == by_kind["tumbling"][0].late
    spec = sliding(2000, 1000)
    missed = sum(r.missed for r in partial_misses(scan, spec, 0).collect())
    first = by_kind["sliding"][0]
    assert first.missed_pairs == missed + 2 * first.late


@pytest.mark.parametrize(
    "arrivals, late",
    [([500, 1000, 3900, 1200], [3]), ([500, 2000, 1900], [2]), ([500, 1999, 1900], [])],
    ids=["closed", "border", "border minus 1 ms"],
)
def test_closed_window_borders(log, arrivals, late):
    scan = arrival_scan(log([(i, e) for i, e in enumerate(arrivals)]), 1, bucket_ms=10)
    assert [r.log_id for r in late_events(scan, tumbling(2000), 0).collect()] == late


def test_sliding_partial_miss_is_not_late(log):
    scan = arrival_scan(log([(0, 500), (1, 2500), (2, 1200)]), 1, bucket_ms=10)
    spec = sliding(2000, 1000)
    assert late_events(scan, spec, 0).count() == 0
    assert [(r.log_id, r.missed) for r in partial_misses(scan, spec, 0).collect()] == [(2, 1)]


def test_no_watermark_before_all_lanes_started(log):
    scan = arrival_scan(log([(0, 9000), (1, 100)]), 3, bucket_ms=10)
    assert [r.seen_ts for r in scan.collect()] == [None, None]
    assert late_events(scan, tumbling(2000), 0).count() == 0


def test_flush_fires_pending_windows(log):
    scan = arrival_scan(log([(0, 500), (1, 2500), (7, 2600)]), 1, bucket_ms=10)
    sweep = [(tumbling(2000), [0])]
    fired = {r.window_end: (r.trigger_ts, r.current_wm) for r in window_firing(scan, sweep).collect()}
    assert fired == {2000: (1, 2499), 4000: (None, None)}
    fired = {r.window_end: (r.trigger_ts, r.current_wm) for r in window_firing(scan, sweep, flush=True).collect()}
    assert fired == {2000: (1, 2499), 4000: (7, 2**63 - 1)}


def test_far_outlier_does_not_multiply_windows(log):
    """One event decades ahead: only windows with events are looked up."""
    scan = arrival_scan(log([(0, 500), (1, 2500), (2, 10**12), (3, 10**12 + 5000)]), 1, bucket_ms=10)
    fired = window_firing(scan, [(tumbling(2000), [0])], block=4).collect()
    assert sorted((r.window_end, r.trigger_ts) for r in fired) == [
        (2000, 1), (4000, 2), (10**12 + 2000, 3), (10**12 + 6000, None),
    ]


def test_negative_event_times(log):
    """Events before 1970 fall in the window below, not towards zero."""
    rows = assign_windows(log([(0, -1), (1, -2000), (2, 0)]), tumbling(2000)).collect()
    assert [r.window_end for r in rows] == [0, 0, 2000]


def test_slide_longer_than_size_is_refused():
    with pytest.raises(ValueError):
        WindowSpec("gaps", 1000, 2000)


def test_grids_share_a_step_only_when_it_pays():
    assert slot_grids([(tumbling(2000), [0, 500, 1000, 1500])]) == [(500, 0)]
    assert slot_grids([(tumbling(2000), [0, 333])]) == [(2000, 0), (2000, 333)]


def test_running_max_disorder(log):
    scan = arrival_scan(log([(0, 10), (1, 30), (2, 20), (3, 25), (4, 40)]), 1, bucket_ms=2)
    got = {r.log_id: r.d for r in scan.selectExpr("log_id", f"{DISORDER_MS} as d").collect()}
    assert got == {0: 0, 1: 0, 2: 10, 3: 5, 4: 0}


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_running_sums_and_percentile_blocks(spark, block):
    rng = random.Random(7)
    rows = [(k, o, rng.randrange(9)) for k in ("a", None) for o in rng.sample(range(-50, 50), 40)]
    frame = spark.createDataFrame(rows, "k STRING, o BIGINT, v BIGINT")
    got = {(r.k, r.o): r.s for r in prefix.running_sums(frame, ["k"], "o", {"v": "s"}, block).collect()}
    assert got == {(k, o): sum(v for k2, o2, v in rows if k2 == k and o2 <= o) for k, o, _ in rows}

    for share in (0.0, 0.5, 0.99, 1.0):
        found = {r.k: r.p_v for r in prefix.exact_percentile(frame, ["k"], "v", share, block).collect()}
        exact = frame.groupBy("k").agg({"v": "max"}).drop("max(v)").collect()
        for (key,) in exact:
            values = sorted(v for k, _, v in rows if k == key)
            at = (len(values) - 1) * share
            low = int(at)
            high = min(low + 1, len(values) - 1)
            assert found[key] == pytest.approx(values[low] + (values[high] - values[low]) * (at - low))


def test_percentile_known_value(spark):
    frame = spark.createDataFrame([(v,) for v in (1, 2, 3, 4)], "v BIGINT")
    assert prefix.exact_percentile(frame, [], "v", 0.99).first()[0] == pytest.approx(3.97)


def test_dense_range_in_parts(spark):
    frame = spark.createDataFrame([("a", 10), ("b", 0)], "k STRING, last BIGINT")
    got = sorted((r.k, r.i) for r in prefix.dense_range(frame, "last", "i", 4).collect())
    assert got == [("a", i) for i in range(11)] + [("b", 0)]


def test_bucket_counts_stay_bounded():
    assert range_bucket_count(0, 1_000_000, 200) == 1
    assert range_bucket_count(10**12, 1_000_000, 200) == 800
    assert range_bucket_count(10**12, 1_000_000, 10**6) == 50_000
    assert narrower_width(86_400_000, 10**9, 365, 10**6) == 86_400_000 // 1000 or narrower_width(86_400_000, 10**9, 365, 10**6) == 86_400_000
    assert narrower_width(86_400_000, 5 * 10**7, 365, 10**6) == 86_400_000 // 50
    assert narrower_width(1, 10**9, 5, 10**6) == 1


def test_narrower_buckets_and_a_hot_millisecond_give_the_same_scan(log):
    pairs = [(1000 * k, 1000 * k - k % 7) for k in range(200)] + [(50_000, 40_000 + k) for k in range(300)]
    frame = log(pairs)

    def seen(**options):
        return {r.log_id: r.seen_ts for r in arrival_scan(frame, 3, bucket_ms=10**6, **options).collect()}

    assert seen() == seen(rows_per_bucket=20, hot_rows=40) == seen(rows_per_bucket=20, hot_rows=400)


def test_late_sweep_is_the_late_events_of_every_lag(log):
    scan = materialize(arrival_scan(log(disorderly(300, 4)), 3), "sweep")
    sweep = [(tumbling(2000), [0, 500]), (sliding(2000, 1000), [0, 1000])]
    got = sorted((r.window_type, r.lag_ms, r.log_id, r.late_by_ms) for r in late_events_sweep(scan, sweep).collect())
    want = [(s.kind, lag, r.log_id, r.late_by_ms) for s, lags in sweep for lag in lags for r in late_events(scan, s, lag).collect()]
    assert got == sorted(want) and want


def test_coded_trace_has_no_row_of_a_lag(spark, log, tmp_path):
    """The stored rows are those of the pairs; every lag is a view of them."""
    from tidemark.operators.trace import coded_trace, firing_table
    from tidemark.sources.sinks import read_coded_trace, write_coded_trace

    scan = materialize(arrival_scan(log(disorderly(400, 12)), 3, bucket_ms=1500), "scan")
    sweep = [(tumbling(2000), [700, 0]), (sliding(3000, 1000), [0, 1500])]
    many = [(spec, [*lags, *range(10, 90, 10)]) for spec, lags in sweep]
    sizes = []
    for k, each in enumerate((sweep, many)):
        write_coded_trace(coded_trace(scan, each, 3), firing_table(scan, each), f"{tmp_path}/{k}")
        sizes.append(spark.read.parquet(f"{tmp_path}/{k}/pairs").count())
    assert sizes[0] == sizes[1] == 400 * 4
    columns = ["window_type", "lag_ms", "task_id", "sys_ts", "event_ts", "log_id", "content", "status", "window_end"]
    whole = trace_rows(scan, many, 3).select(columns).collect()
    assert sorted(read_coded_trace(spark, f"{tmp_path}/1", many).select(columns).collect()) == sorted(whole)
    for lag in (0, 700, 80):
        one = read_coded_trace(spark, f"{tmp_path}/1", many, lag_ms=lag).select(columns).collect()
        assert one and sorted(one) == sorted(r for r in whole if r.lag_ms == lag)
