import pytest

from tests.test_windows_and_watermarks import disorderly
from tidemark.plans.tradeoff import tradeoff_from_summaries
from tidemark.sources import replay_files, run_files, sinks, summaries
from tidemark.session import lookup_join
import tidemark.session as session_module

TRACE_HEAD = "task_id,sys_ts,event_ts,log_id,content,status,window_end\n"
METRIC_HEAD = "task_id,window_end,trigger_ts,count_actual,count_expected,loss_network,lag_system,current_wm\n"


@pytest.fixture
def stored(tmp_path):
    """A folder with run files named as the experiment jobs name them."""
    tumbling = "3p0.5klag-{}_P3_task-{}.csv"
    sliding = "slide21k-1klag_Sliding_SZ2000_SL1000_P3_task-{}_{}.csv"
    for task in range(2):
        body = f"{task},3000,1500,{task},c,NORMAL,2000\n{task},3100,900,{task + 10},c,LATE,-1\n"
        (tmp_path / tumbling.format("all-data-trace", task)).write_text(TRACE_HEAD + body)
        (tmp_path / sliding.format(task, "trace")).write_text(TRACE_HEAD + body)
        body = f"{task},2000,3000,1,1,0,1000,2499\n"
        (tmp_path / tumbling.format("window_Tumbling", task)).write_text(METRIC_HEAD + body)
        (tmp_path / sliding.format(task, "metrics")).write_text(METRIC_HEAD + body)
    (tmp_path / "notes.txt").write_text("nothing")
    return str(tmp_path)


def test_run_discovery(spark, stored):
    assert [r.run_id for r in run_files.discover_runs(spark, stored).collect()] == [
        "3p0.5klag-all-data-trace_P3",
        "3p0.5klag-window_Tumbling_P3",
        "slide21k-1klag_Sliding_SZ2000_SL1000_P3",
    ]


def test_stored_traces_and_metrics_are_kept_apart(spark, stored):
    traces, metrics = run_files.read_traces(spark, stored), run_files.read_metrics(spark, stored)
    assert (run_files.table_kind(traces), run_files.table_kind(metrics)) == ("trace", "metrics")
    assert traces.count() == 8 and metrics.count() == 4
    one = run_files.select_run(traces, "slide21k-1klag_Sliding_SZ2000_SL1000_P3")
    assert sorted((r.lag_ms, r.file_task, r.status) for r in one.collect()) == [
        (1000, 0, "LATE"), (1000, 0, "NORMAL"), (1000, 1, "LATE"), (1000, 1, "NORMAL"),
    ]
    with pytest.raises(ValueError):
        run_files.table_kind(spark.range(1))


def test_folder_without_run_files(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("nothing")
    assert run_files.read_traces(spark, str(tmp_path)).count() == 0


def test_replay_file_round_trip(spark, log, tmp_path):
    frame = log(disorderly(200, 9)).selectExpr("*", "arrival_ts - event_ts as delay_ms")
    path = str(tmp_path / "replay")
    replay_files.write_replay(replay_files.to_replay(frame, 90_000), path)
    text = "".join(r.value for r in spark.read.text(path).limit(1).collect())
    assert text == "send_offset,event_offset,id,delay,content"
    back = replay_files.replay_events(replay_files.read_replay(spark, path), 90.0)
    # Offsets are binary fractions of a second, truncated to ms: up to 1 ms below.
    both = back.alias("b").join(frame.alias("f"), "log_id")
    near = "f.event_ts - b.event_ts between 0 and 1 and f.arrival_ts - b.arrival_ts between 0 and 1"
    assert both.where(f"{near} and f.delay_ms = b.delay_ms and f.content = b.content").count() == 200


def test_trace_sink_quotes_content(spark, tmp_path):
    rows = [("r", 0, 10, 5, 1, 'a,"b",c', "NORMAL", 20)]
    layout = "run_id STRING, task_id INT, sys_ts BIGINT, event_ts BIGINT, log_id BIGINT, content STRING, status STRING, window_end BIGINT"
    path = str(tmp_path / "trace")
    sinks.write_trace(spark.createDataFrame(rows, layout), path, ["run_id"], "csv")
    back = spark.read.schema(layout).option("header", True).csv(path).select("run_id", "content", "window_end")
    assert tuple(back.first()) == ("r", 'a,"b",c', 20)


def test_series_and_tradeoff_sinks(spark, tmp_path):
    rows = spark.sql("select 'r' as run_id, id as relative_time_s, 1D as throughput, 1D as processed_count, 0D as drop_rate, 0D as avg_delay_processed from range(5)")
    sinks.write_series(rows, str(tmp_path / "series"), ["run_id"])
    assert spark.read.option("header", True).csv(str(tmp_path / "series")).count() == 5
    table = spark.sql("select 'x' as run_id, 0.5D as lag_s, 0.1D as drop_rate, 1D as avg_latency_s, 2D as avg_trigger_delay_s, 'sliding' as window_type")
    sinks.write_tradeoff(table, str(tmp_path / "table"))
    got = spark.read.option("header", True).csv(str(tmp_path / "table"))
    assert got.columns == ["Experiment", "Lag", "DropRate", "AvgLatency", "TriggerDelay", "Type"]
    assert got.first().Type == "Sliding Window"
    with pytest.raises(ValueError):
        sinks.rewrite(table, "/data/x/", "/data/x", [])


def test_summary_texts_round_trip(spark, tmp_path):
    rows = [("3p0klag-all-data-trace_P3", 13926, 12078, 1848, 1848 / 13926, 1.56683)]
    texts = summaries.summary_texts(
        spark.createDataFrame(rows, "run_id STRING, rows BIGINT, processed BIGINT, late BIGINT, drop_rate DOUBLE, avg_latency_s DOUBLE")
    )
    assert texts.first().value.splitlines() == [
        "实验: 3p0klag-all-data-trace_P3", "总数据量(清洗后): 13926", "处理数据量: 12078",
        "丢弃数据量(LATE): 1848", "总丢弃率: 13.27%", "平均处理延迟: 1.5668 s",
    ]
    for run, name, text in [
        (rows[0][0], summaries.SUMMARY_FILE, texts.first().value),
        ("slide21k-0klag_Sliding_SZ2000_SL1000_P3", summaries.SUMMARY_FILE, "总丢弃率: 1.50%\n平均处理延迟: 1.6569 s\n"),
        ("slide21k-0klag_Sliding_SZ2000_SL1000_P3", summaries.WINDOW_SUMMARY_FILE, "平均窗口触发延迟: 0.5915 s\n"),
        ("3p0klag-window_Tumbling_P3", summaries.WINDOW_SUMMARY_FILE, "平均窗口触发延迟: 0.4865 s\n"),
        ("3p1klag-all-data-trace_P3", summaries.SUMMARY_FILE, "broken"),
        ("warmup", summaries.SUMMARY_FILE, "总丢弃率: 9.00%"),
    ]:
        (tmp_path / run).mkdir(exist_ok=True)
        (tmp_path / run / name).write_text(text, encoding="utf-8")
    traces = summaries.parse_summaries(summaries.read_texts(spark, str(tmp_path), summaries.SUMMARY_FILE))
    windows = summaries.parse_window_summaries(summaries.read_texts(spark, str(tmp_path), summaries.WINDOW_SUMMARY_FILE))
    table = [tuple(r) for r in tradeoff_from_summaries(traces, windows).collect()]
    assert table == [
        ("3p0klag-all-data-trace_P3", 0.0, pytest.approx(0.1327), 1.5668, 0.4865, "tumbling"),
        ("slide21k-0klag_Sliding_SZ2000_SL1000_P3", 0.0, pytest.approx(0.015), 1.6569, 0.5915, "sliding"),
        ("3p1klag-all-data-trace_P3", 1.0, 0.0, 0.0, 0.0, "tumbling"),
    ]


def test_lookup_join_beyond_the_broadcast_limit(spark, monkeypatch):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k INT, v STRING")
    right = spark.createDataFrame([(1, 10), (None, 20)], "k INT, w INT")
    small = sorted(map(str, lookup_join(left, right, ["k"], "left").collect()))
    monkeypatch.setattr(session_module, "BROADCAST_ROWS", 0)
    large = lookup_join(left, right, ["k"], "left")
    assert sorted(map(str, large.collect())) == small and len(small) == 3


TRACE_NAME = "3p1klag-all-data-trace_P3_task-0.csv"


def test_content_with_commas_and_bad_lines(spark, tmp_path):
    lines = [
        "0,3000,1500,2,a,b,c,NORMAL,2000", '1,3000,1500,3,"quoted, ""twice""",LATE,-1', "2,3000,1500,4,,NORMAL,2000", "0,3000,1500",
        "0,x,1500,5,c,NORMAL,2000", "0,3000,1500,6,c,OTHER,2000", "0,3000,1500,7,c,NORMAL,", "",
    ]
    (tmp_path / TRACE_NAME).write_text(TRACE_HEAD + "\n".join(lines) + "\n")
    rows = run_files.read_traces(spark, str(tmp_path)).orderBy("log_id").collect()
    assert [(r.log_id, r.content, r.status, r.window_end) for r in rows] == [
        (2, "a,b,c", "NORMAL", 2000), (3, 'quoted, "twice"', "LATE", -1), (4, "", "NORMAL", 2000),
    ]
    found = {r.value: r.reason for r in run_files.rejects(spark, str(tmp_path)).collect()}
    assert found == dict(zip(lines[3:7], ["number of fields", "bad sys_ts", "bad status", "bad window_end"], strict=True))


def test_metric_rejects(spark, tmp_path):
    name = "3p1klag-window_Tumbling_P3_task-0.csv"
    (tmp_path / name).write_text(METRIC_HEAD + "0,2000,3000,1,1,0,1000,2499\n0,2000,3000,1,1,0,1000\n0,2000,3000,1,1,0,1000,9,9\n")
    assert run_files.read_metrics(spark, str(tmp_path)).count() == 1
    assert [r.reason for r in run_files.rejects(spark, str(tmp_path), "metrics").collect()] == ["number of fields"] * 2


def test_no_file_is_reported_when_all_can_be_read(spark, stored):
    assert run_files.read_traces(spark, stored, skip_corrupt=True).count() == 8
    assert run_files.unread_files(spark, stored).count() == 0


def test_lines_become_one_file_a_name(spark, tmp_path):
    lines = spark.createDataFrame([("r_task-0", "a,b"), ("r_task-0", "c"), ("x p_task-1", "d")], "file STRING, value STRING")
    run_files.write_lines(lines, str(tmp_path / "out"), "head")
    texts = {p.name: p.read_text() for p in (tmp_path / "out").glob("*.csv")}
    assert sorted(texts) == ["r_task-0.csv", "x p_task-1.csv"]
    assert texts["r_task-0.csv"].startswith("head\n") and sorted(texts["r_task-0.csv"].split()) == ["a,b", "c", "head"]


def test_tradeoff_sink_takes_a_run_name(spark, tmp_path):
    table = spark.createDataFrame([("tumbling", 1000, 1.0, 0.1, 2.0, 0.5)], "window_type STRING, lag_ms INT, lag_s DOUBLE, drop_rate DOUBLE, avg_latency_s DOUBLE, avg_trigger_delay_s DOUBLE")
    sinks.write_tradeoff(table, str(tmp_path / "t"), "concat(window_type, '-', lag_ms)")
    row = spark.read.option("header", True).csv(str(tmp_path / "t")).first()
    assert row.Experiment == "tumbling-1000" and row.Type == "Tumbling Window"


def test_large_run_files_are_written_in_parts(spark, tmp_path):
    rows = [("3p1klag-all-data-trace_P3_task-0", f"0,3000,1500,{k},c,NORMAL,2000") for k in range(250)]
    rows += [("3p1klag-all-data-trace_P3_task-1", "1,3000,1500,7,c,NORMAL,2000")]
    lines = spark.createDataFrame(rows, "file STRING, value STRING").repartition(3)
    folder = str(tmp_path / "parts")
    run_files.write_lines(lines, folder, TRACE_HEAD.strip(), rows_per_part=100)
    names = sorted(p.name for p in (tmp_path / "parts").iterdir() if p.name.endswith(".csv"))
    assert names == [f"3p1klag-all-data-trace_P3_task-0.part-{k}.csv" for k in range(3)] + ["3p1klag-all-data-trace_P3_task-1.csv"]
    assert all((tmp_path / "parts" / n).read_text().startswith(TRACE_HEAD) for n in names)
    found = run_files.read_traces(spark, folder).collect()
    assert len(found) == 251 and {(r.run_id, r.file_task) for r in found} == {("3p1klag-all-data-trace_P3", 0), ("3p1klag-all-data-trace_P3", 1)}
    assert run_files.discover_runs(spark, folder).count() == 1


def test_unknown_runs_are_listed(spark):
    from tidemark.plans.tradeoff import unknown_runs

    names = [("3p1klag-all-data-trace_P3",), ("4p1klag-all-data-trace_P4",), ("other-1klag",), ("3p-trace",)]
    got = {tuple(r) for r in unknown_runs(spark.createDataFrame(names, "run_id STRING")).collect()}
    assert got == {("other-1klag", "unknown type"), ("3p-trace", "no lag")}


def test_lines_are_made_of_rows_that_have_been_moved(spark, tmp_path):
    """Rows make lines of up to three files; the lines themselves are not shuffled."""
    rows = spark.sql("select id % 2 as task, id from range(0, 60, 1, 4)")

    def each(moved):
        named = moved.selectExpr("_part", "inline(array(struct('a' as run, id), struct('b' as run, id), struct('c' as run, id))) as (run, id)")
        named = named.where("run <> 'c' or id = 7").selectExpr("*", "spark_partition_id() as place")
        return named.selectExpr("_part", "concat(run, '-1klag_P2_task-', _part.task, '_trace') as file", "concat(id, ' ', place) as value")

    run_files.write_lines(rows, str(tmp_path / "out"), "head", 10, ("task",), "xxhash64(id)", each)
    texts = {p.name: p.read_text().splitlines() for p in (tmp_path / "out").glob("*.csv")}
    assert {n.split(".")[0] for n in texts} == {f"{run}-1klag_P2_task-{k}_trace" for run, k in ("a0", "a1", "b0", "b1", "c1")}
    assert all(lines[0] == "head" and lines.count("head") == 1 and len(lines) > 1 for lines in texts.values())
    for run, ids in (("a", range(60)), ("b", range(60)), ("c", [7])):
        lines = [line.split() for name, found in texts.items() if name[0] == run for line in found[1:]]
        assert sorted(int(k) for k, _ in lines) == list(ids)
    # All files that a part of a group has come from one task.
    places = {}
    for name, found in texts.items():
        places.setdefault(name.partition("_task-")[2], set()).update(line.split()[1] for line in found[1:])
    assert all(len(p) == 1 for p in places.values()) and len(places) == 6


def test_a_line_is_split_once(spark, stored, capsys):
    for rows in (run_files.read_traces(spark, stored), run_files.rejects(spark, stored), run_files.read_metrics(spark, stored)):
        rows.explain()
        assert capsys.readouterr().out.count("split(value") == 1


def test_the_last_run_is_found_without_reading_lines(spark, stored):
    runs = run_files.discover_runs(spark, stored, run_files.TRACE_FILES)
    assert [r.run_id for r in runs.collect()] == ["3p0.5klag-all-data-trace_P3", "slide21k-1klag_Sliding_SZ2000_SL1000_P3"]
