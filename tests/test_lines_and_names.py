from pyspark.sql import functions as F

from tidemark.functions.messages import late_message, window_message
from tidemark.functions.naming import WINDOW_MARK, lag_seconds, run_prefix, task_number, window_kind
from tidemark.functions.parse import format_line, lane_key, offset_to_epoch_ms, parse_lines, parse_rejects
from tidemark.operators.delay import delay_quantiles, inject_delay, lose


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value STRING")


def test_parse_keeps_commas_and_strips_all_blanks(spark):
    got = parse_lines(lines(spark, "10,7,a,b,c", "\t 11,8,x  \n", "12,9,")).collect()
    assert [tuple(r) for r in got[:1]] == [(10, 7, "a,b,c")]
    assert (got[1].event_ts, got[1].log_id, got[1].content.strip()) == (11, 8, "x")
    assert (got[2].event_ts, got[2].log_id, got[2].content) == (12, 9, "")


def test_bad_lines_are_rejected_with_a_reason(spark):
    bad = {
        "": "missing field",
        "5,6": "missing field",
        "x,6,c": "bad event_ts",
        "5,1_0,c": "bad log_id",
        "5,7.5,c": "bad log_id",
        "5,99999999999999999999,c": "bad log_id",
    }
    rows = lines(spark, "5, 7 ,ok", "5,3000000000,big", *bad)
    assert [r.log_id for r in parse_lines(rows).collect()] == [7, 3_000_000_000]
    assert {r.value: r.reason for r in parse_rejects(rows).collect()} == bad
    assert [r.log_id for r in parse_lines(rows, id_type="int").collect()] == [7]
    assert parse_rejects(rows, id_type="int").count() == len(bad) + 1


def test_blanks_of_all_scripts_are_stripped(spark):
    pads = ["\u00a0", "\u3000", "\u2003", "\u0085", "\u2028", "\x1c", "\x1f", "\t \r", "\u202f\u205f\u1680"]
    rows = lines(spark, *[f"{p}5,{k},a\u00a0b{p}" for k, p in enumerate(pads)])
    assert [(r.log_id, r.content) for r in parse_lines(rows).orderBy("log_id").collect()] == [(k, "a\u00a0b") for k in range(len(pads))]


def test_delays_of_any_id(spark):
    ids = [0, 999, 1000, -1, -1000, -123456, 2 * 10**15, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(i, 0) for i in ids], "log_id BIGINT, event_ts BIGINT")
    got = {r.log_id: r.delay_ms for r in inject_delay(rows).collect()}
    table = delay_quantiles()
    assert got == {i: table[(i % 1000 * 7919 + i // 1000 * 104729) % 1000] for i in ids}
    assert {r.log_id for r in lose(rows).collect()} == {i for i in ids if (i * 31 + 7) % 100 >= 2}


def test_delay_table_matches_its_stored_facts():
    assert sum(delay_quantiles()) == 506_172 and max(delay_quantiles()) == 5_116


def test_line_round_trip_and_keys(spark):
    frame = spark.createDataFrame([(10, -4, "a,b")], "event_ts BIGINT, log_id BIGINT, content STRING")
    back = parse_lines(frame.selectExpr(f"{format_line('event_ts', 'log_id', 'content')} as value"))
    assert tuple(back.first()) == (10, -4, "a,b")
    assert back.selectExpr(lane_key("log_id", 3)).first()[0] == 2 * 1001


def test_offsets_are_truncated_to_ms(spark):
    got = spark.range(1).selectExpr(offset_to_epoch_ms("1700000000.5D", "1.2345D")).first()[0]
    assert got == 1700000001734


def test_names(spark):
    names = {
        "3p0.5klag-all-data-trace_P3": (0.5, "tumbling"),
        "3p5klag-window_Tumbling_P3": (5.0, "unknown"),
        "slide21k-1.5klag_Sliding_SZ2000_SL1000_P3": (1.5, "sliding"),
        "warmup": (None, "unknown"),
    }
    frame = spark.createDataFrame([(n,) for n in names], "name STRING")
    got = frame.selectExpr("name", lag_seconds("name"), window_kind("name")).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == names
    assert frame.where(f"{window_kind('name', WINDOW_MARK)} = 'tumbling'").count() == 1
    files = spark.createDataFrame([("3p0klag-window_Tumbling_P3_task-12.csv",), ("readme.csv",)], "f STRING")
    got = files.selectExpr(run_prefix("f"), task_number("f")).collect()
    assert [tuple(r) for r in got] == [("3p0klag-window_Tumbling_P3", 12), (None, None)]


def test_messages(spark):
    row = spark.sql("select 1 as t, 'tumbling' as k, 2000L as e, 2100L as w, 5L as n")
    assert row.selectExpr(window_message("t", "k", "e", "w", "n")).first()[0] == (
        "[1-TUMBLING] >>> 🪟 [Win 2000] [WM=2100] | Count=5"
    )
    assert row.selectExpr(late_message("t", "n")).first()[0] == "[1] ⚠️ [LATE DROP] ID=5"


def test_delay_model(spark):
    quantiles = delay_quantiles()
    assert (len(quantiles), sum(quantiles), max(quantiles), min(quantiles)) == (1000, 506_172, 5_116, 50)
    assert 0.016 < sum(q > 2000 for q in quantiles) / 1000 < 0.018
    events = spark.range(5000).select(F.col("id").alias("log_id"), (F.col("id") * 10).alias("event_ts"))
    assert lose(events).count() == 4900
    row = inject_delay(events, 3).agg(F.sum("delay_ms"), F.min("delay_ms")).first()
    assert tuple(row) == (5 * 3 * 506_172, 150)


def test_own_run_names_come_back_for_any_lanes(spark):
    from tidemark.functions.naming import run_name

    for lanes in (1, 3, 4, 13, 128):
        for kind in ("tumbling", "sliding"):
            name = run_name(kind, "1.5D", 2000, 1000, lanes)
            got = spark.range(1).selectExpr(f"{name} as name").selectExpr(lag_seconds("name"), window_kind("name")).first()
            assert tuple(got) == (1.5, kind)
    odd = spark.createDataFrame([("xp5klag-trace",), ("3pxklag-trace",), ("top5klag-trace",)], "name STRING")
    assert {r[0] for r in odd.selectExpr(window_kind("name")).collect()} == {"unknown"}


def test_lines_are_split_once(spark):
    """However many fields and filters stand above, each line is stripped and split once."""
    for rows in (parse_lines(lines(spark, "1,2,c")), parse_rejects(lines(spark, "1,2"))):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1
