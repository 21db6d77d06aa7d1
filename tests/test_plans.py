"""Plans: narrow scans, no cross joins, no Python, no single-task pass over the rows."""

import pytest

from catalog.queries import QUERIES, arrivals
from tidemark.operators.arrival_scan import arrival_scan
from tidemark.operators.lateness import drop_rates
from tidemark.operators.windows import tumbling

SF_DIR = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["lag_sweep", "trace_rows", "tradeoff_table", "watermark_range_buckets", "traffic_density"])
def test_plans_stay_in_the_engine(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "InArrow"):
        assert bad not in text


def test_scan_reads_only_what_it_needs(spark):
    text = plan(arrivals(spark, SF_DIR).select("arrival_ts", "log_id", "event_ts"))
    schema = text[text.index("ReadSchema:") :].splitlines()[0]
    assert "event_id" in schema and "ts" in schema and "props" not in schema and "event_type" not in schema


def test_drop_rates_shuffle_partial_sums_only(spark):
    frame = arrivals(spark, SF_DIR).select("arrival_ts", "log_id", "event_ts")
    text = plan(drop_rates(arrival_scan(frame, 3, bucket_ms=86_400_000), [tumbling(7_200_000)], [0, 3_600_000]))
    # The only exchanges: one row per task, and the broadcast of the carried rows.
    assert text.count("Exchange") == 2 and "BroadcastExchange" in text and "partial_sum" in text
    assert "Window" not in text
