import pytest

from tests.test_windows_and_watermarks import disorderly
from tidemark.operators.arrival_scan import arrival_scan
from tidemark.operators.resume import resumed_scan, scan_in_parts, scan_state, store_state


@pytest.mark.parametrize("lanes, cuts", [(1, [0.5]), (3, [0.001, 0.3, 0.31]), (4, [0.7])], ids=str)
def test_parts_give_the_scan_of_the_whole(log, lanes, cuts):
    """Also with parts of fewer rows than lanes, and empty ones."""
    pairs = disorderly(500, 21)
    frame = log(pairs).selectExpr("*", "if(log_id % 3 = 0, null, concat('s', log_id % 3)) as source").drop("content")
    ordered = sorted(a for a, _ in pairs)
    borders = [-1, *[ordered[int(c * 500)] for c in cuts], ordered[int(cuts[-1] * 500)], 10**9]
    parts = [frame.where(f"arrival_ts > {a} and arrival_ts <= {b}") for a, b in zip(borders, borders[1:])]
    for by in ((), ("source",)):
        whole = arrival_scan(frame, lanes, by, bucket_ms=700).collect()
        got = [r for part in scan_in_parts(parts, lanes, by, bucket_ms=700) for r in part.collect()]
        assert sorted(map(str, got)) == sorted(map(str, whole)) and len(got) == 500


def test_old_rows_are_not_read_again(spark, log, tmp_path):
    frame = log(disorderly(300, 22)).drop("content")
    cut = frame.selectExpr("percentile(arrival_ts, 0.5)").first()[0]
    first = arrival_scan(frame.where(f"arrival_ts <= {cut}"), 3, bucket_ms=700)
    state = store_state(scan_state(first, 3), f"{tmp_path}/state")
    assert state.count() == 1 and len(state.first()["tops"]) == 3
    later = resumed_scan(frame.where(f"arrival_ts > {cut}"), state, 3, bucket_ms=700)
    assert later.count() == 300 - first.count()
    with pytest.raises(ValueError, match="come before"):
        resumed_scan(frame, state, 3, bucket_ms=700)


def test_empty_state_and_logs_without_new_rows(spark, log):
    frame = log(disorderly(60, 23)).selectExpr("*", "if(log_id < 30, 'a', 'b') as source").drop("content")
    nothing = scan_state(arrival_scan(frame.limit(0), 2, ("source",), bucket_ms=700), 2, ("source",))
    assert nothing.count() == 0
    whole = arrival_scan(frame, 2, ("source",), bucket_ms=700).collect()
    assert sorted(map(str, resumed_scan(frame, nothing, 2, ("source",), bucket_ms=700).collect())) == sorted(map(str, whole))
    state = scan_state(arrival_scan(frame.where("source = 'a'"), 2, ("source",), bucket_ms=700), 2, ("source",))
    after = scan_state(resumed_scan(frame.where("source = 'b'"), state, 2, ("source",), bucket_ms=700), 2, ("source",), state)
    assert {(r.source, r.rows) for r in after.collect()} == {("a", 30), ("b", 30)}
    plain = scan_state(arrival_scan(frame.limit(0), 2, bucket_ms=700), 2)
    assert sorted(map(str, resumed_scan(frame, plain, 2, bucket_ms=700).collect())) == sorted(map(str, arrival_scan(frame, 2, bucket_ms=700).collect()))
