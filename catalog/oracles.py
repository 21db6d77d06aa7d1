"""The registered queries as plain SQL over the whole tables."""

from __future__ import annotations

from catalog.settings import (
    CUTOFF_S, FEED_SLICE, HORIZON, HOUR, LAG, LAGS, LANES, SCALE, SIZE, SLIDE,
)
from tidemark.operators.delay import QUANTILES, delay_quantiles

KINDS = ("tumbling", "sliding")

# Message formats and padding, written out so that SQL does not repeat the code under test.
WINDOW_FORMAT = "[%d-%s] >>> 🪟 [Win %d] [WM=%d] | Count=%d"
LATE_FORMAT = "[%d] ⚠️ [LATE DROP] ID=%d"
PAD = r"[\t-\r\x{1c}- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

DELAYS = f"[{', '.join(map(str, delay_quantiles()))}]"

EVENTS = """ev AS (
  SELECT epoch_us(ts) // 1000 AS event_ts, event_id AS log_id, props AS content, event_type AS source FROM events)"""

LOG = f"""{EVENTS}, log AS (
  SELECT *, event_ts + delay_ms AS arrival_ts FROM (
    SELECT *, CAST(({DELAYS})[(log_id * 7919 + (log_id // {QUANTILES}) * 104729) % {QUANTILES} + 1] AS BIGINT)
           * {SCALE} AS delay_ms FROM ev))"""


def scan(lanes: int = LANES, by: str = "", log: str = "log") -> str:
    """CTE ``scan``: lane, and minimum over the lanes of the running maximum."""
    part = f"PARTITION BY {by} " if by else ""
    tops = ", ".join(
        f"max(CASE WHEN idx % {lanes} = {k} THEN event_ts END) OVER ({part}ORDER BY idx ROWS UNBOUNDED PRECEDING) AS t{k}"
        for k in range(lanes)
    )
    started = " AND ".join(f"t{k} IS NOT NULL" for k in range(lanes))
    least = f"least({', '.join(f't{k}' for k in range(lanes))})"
    return f"""ranked AS (
  SELECT *, row_number() OVER ({part}ORDER BY arrival_ts, log_id, event_ts) - 1 AS idx FROM {log}),
scan AS (
  SELECT * EXCLUDE ({', '.join(f't{k}' for k in range(lanes))}), idx % {lanes} AS lane,
         CASE WHEN {started} THEN {least} END AS seen_ts
  FROM (SELECT *, {tops} FROM ranked))"""


SCAN = f"{LOG}, {scan()}"


def lag_rows(kinds=KINDS, lags=LAGS) -> str:
    rows = ", ".join(f"('{kind}', CAST({lag} AS BIGINT))" for kind in kinds for lag in lags[kind])
    return f"lags(window_type, lag_ms) AS (VALUES {rows})"


def last_end(kind: str) -> str:
    return f"(event_ts - event_ts % {SLIDE[kind]} + {SIZE})"


def pair_rows(kinds=KINDS) -> str:
    """CTE ``pairs``: one row per (event, window) with the end of its last window."""
    parts = [
        f"SELECT '{kind}' AS window_type, scan.*, {last_end(kind)} AS last_end, "
        f"{last_end(kind)} - k * {SLIDE[kind]} AS window_end "
        f"FROM scan, range({SIZE // SLIDE[kind]}) AS steps(k)"
        for kind in kinds
    ]
    return f"pairs AS ({' UNION ALL '.join(parts)})"


CLOSED = "coalesce(window_end + lag_ms <= seen_ts, false)"
ALL_CLOSED = "coalesce(last_end + lag_ms <= seen_ts, false)"

STEPS = "steps AS (SELECT seen_ts, min(arrival_ts) AS fire_ts FROM scan WHERE seen_ts IS NOT NULL GROUP BY seen_ts)"


def fired(source: str) -> str:
    """Window rows with the first row at which the watermark has passed their end."""
    return f"""SELECT w.*, s.fire_ts AS trigger_ts, s.seen_ts - w.lag_ms - 1 AS current_wm
  FROM (SELECT *, window_end + lag_ms AS threshold FROM {source}) w
  ASOF LEFT JOIN steps s ON w.threshold <= s.seen_ts"""


def metric_rows(kinds=KINDS, lags=LAGS) -> str:
    return f"""{lag_rows(kinds, lags)}, {pair_rows(kinds)}, {STEPS},
counts AS (
  SELECT window_type, lag_ms, log_id % {LANES} AS task_id, window_end, count(*) AS count_actual,
         min(log_id) AS min_id, max(log_id) AS max_id
  FROM pairs JOIN lags USING (window_type) WHERE NOT {CLOSED} GROUP BY ALL),
metrics AS (
  SELECT *, task_id * 1001 AS key, max_id - min_id + 1 AS count_expected,
         max_id - min_id + 1 - count_actual AS loss_network,
         (max_id - min_id) // {LANES} + 1 AS count_expected_stride,
         (max_id - min_id) // {LANES} + 1 - count_actual AS loss_stride,
         trigger_ts - window_end AS lag_system
  FROM ({fired('counts')}) WHERE trigger_ts IS NOT NULL)"""


def trace(kinds=KINDS, lags=LAGS, prefix: str = "") -> str:
    return f"""{lag_rows(kinds, lags)}, {pair_rows(kinds)}, {STEPS},
windows AS (SELECT DISTINCT window_type, lag_ms, window_end FROM pairs JOIN lags USING (window_type)),
firing AS ({fired('windows')}),
trace AS (
  SELECT window_type, lag_ms, log_id % {LANES} AS task_id, trigger_ts AS sys_ts, event_ts, log_id, content,
         'NORMAL' AS status, window_end
  FROM pairs JOIN lags USING (window_type) JOIN firing USING (window_type, lag_ms, window_end)
  WHERE NOT {CLOSED} AND trigger_ts IS NOT NULL
  UNION ALL
  SELECT window_type, lag_ms, log_id % {LANES}, arrival_ts, event_ts, log_id, content, 'LATE', -1
  FROM pairs JOIN lags USING (window_type) WHERE window_end = last_end AND {ALL_CLOSED})"""


CUT = CUTOFF_S * HOUR

KEPT = f"""bounds AS (
  SELECT window_type, lag_ms, min(sys_ts) AS start_ts, max(sys_ts) AS last_ts FROM trace GROUP BY ALL),
kept AS (
  SELECT trace.*, (sys_ts - start_ts) // {HOUR} AS sec FROM trace JOIN bounds USING (window_type, lag_ms)
  WHERE sys_ts <= last_ts - {CUT})"""

SUMMARY = f"""summary AS (
  SELECT window_type, lag_ms, count(*) AS "rows", count(*) FILTER (status = 'NORMAL') AS processed,
         count(*) FILTER (status = 'LATE') AS late,
         count(*) FILTER (status = 'LATE') / count(*) AS drop_rate,
         sum(sys_ts - event_ts) FILTER (status = 'NORMAL') / {HOUR}.0::DOUBLE
           / count(*) FILTER (status = 'NORMAL') AS avg_latency_s
  FROM kept GROUP BY ALL)"""

WINDOW_SUMMARY = f"""metric_bounds AS (
  SELECT window_type, lag_ms, max(trigger_ts) AS last_ts FROM metrics GROUP BY ALL),
window_summary AS (
  SELECT window_type, lag_ms, count(*) AS windows,
         CAST(sum(trigger_ts - window_end) AS DOUBLE) / {HOUR} / count(*) AS avg_trigger_delay_s
  FROM metrics JOIN metric_bounds USING (window_type, lag_ms) WHERE trigger_ts <= last_ts - {CUT} GROUP BY ALL)"""


def _merge_ctes(trace_part: str, lags=LAGS) -> str:
    """Trace and metric CTEs share their first CTEs; keep the metric ones out."""
    metrics = metric_rows(lags=lags)
    return f"{trace_part}, {metrics[metrics.index('counts AS (') :]}"




def tradeoff(source: str = SCAN, lags=LAGS) -> str:
    return f"""{source}, {_merge_ctes(trace(lags=lags), lags)}, {KEPT}, {SUMMARY}, {WINDOW_SUMMARY},
tradeoff AS (
  SELECT s.window_type, s.lag_ms, s.lag_ms / {HOUR}.0::DOUBLE AS lag_s, s.drop_rate, s.avg_latency_s,
         coalesce(w.avg_trigger_delay_s, 0.0) AS avg_trigger_delay_s
  FROM summary s LEFT JOIN window_summary w USING (window_type, lag_ms))"""


TRADEOFF = tradeoff()

ADAPTIVE_LAGS = f"""{LOG}, adaptive_lags AS (
  WITH {scan(1)}, placed AS (
    SELECT arrival_ts // {HORIZON} AS horizon, greatest(seen_ts - event_ts, 0) AS disorder_ms,
           row_number() OVER (PARTITION BY arrival_ts // {HORIZON} ORDER BY greatest(seen_ts - event_ts, 0)) AS place,
           count(*) OVER (PARTITION BY arrival_ts // {HORIZON}) AS n
    FROM scan)
  SELECT horizon, n AS "rows",
         CAST(coalesce(lag(min(disorder_ms) FILTER (place * 1000 >= 990 * n)) OVER (ORDER BY horizon), {LAG}) AS BIGINT) AS lag_ms
  FROM placed GROUP BY horizon, n)"""
ADAPTIVE = f"""{ADAPTIVE_LAGS}, shifted AS (
  SELECT * REPLACE (event_ts - lag_ms AS event_ts), event_ts AS true_ts
  FROM log JOIN adaptive_lags ON horizon = arrival_ts // {HORIZON}),
scan AS (
  WITH {scan(log='shifted')}
  SELECT * EXCLUDE (true_ts, lag_ms, horizon, "rows") REPLACE (true_ts AS event_ts) FROM scan)"""

SKEW = "task_id * 900000 - 400000"
OFFSETS = f"""offsets AS (
  SELECT *, lag_ms + {100 * SCALE} - min_lag_system AS offset_ms FROM (
    SELECT window_type, lag_ms, task_id, min(skewed_ts - window_end) AS min_lag_system
    FROM skewed WHERE window_end > 0 GROUP BY ALL)),
applied AS (
  SELECT *, CASE WHEN abs(offset_ms) > {10 * SCALE} THEN offset_ms ELSE 0 END AS applied_ms FROM offsets)"""


def run_id(trace_name: str = "all-data-trace") -> str:
    number = f"regexp_replace(CAST(lag_ms / {HOUR}.0::DOUBLE AS VARCHAR), '\\.0$', '')"
    return f"""CASE window_type
    WHEN 'tumbling' THEN '{LANES}p' || {number} || 'klag-{trace_name}_P{LANES}'
    ELSE 'slide21k-' || {number} || 'klag_Sliding_SZ2000_SL1000_P{LANES}' END"""


def text_lines(source: str) -> str:
    line = "concat_ws(',', event_ts, log_id, content)"
    return f"""lines AS (
  SELECT log_id AS line_no, * EXCLUDE (log_id), CASE log_id % 50
    WHEN 0 THEN concat_ws(',', event_ts, log_id)
    WHEN 1 THEN concat_ws(',', event_ts, 'x' || log_id, content)
    WHEN 2 THEN concat_ws(',', event_ts, log_id + 3000000000, content)
    WHEN 3 THEN chr(9) || ' ' || {line} || ' ' || chr(9)
    WHEN 4 THEN {line} || ',a,b'
    WHEN 5 THEN chr(160) || chr(12288) || {line} || chr(8195) || chr(133)
    WHEN 6 THEN concat_ws(',', event_ts, log_id || '99999999999999999999', content)
    WHEN 7 THEN concat_ws(',', '1_0', log_id, content)
    ELSE {line} END AS value FROM {source}),
split AS (
  SELECT line_no, value, f.a AS a, f.b AS b, f.c AS c, full_line FROM (
    SELECT *, regexp_full_match(trim_value, '([^,]*),([^,]*),(.*)', 's') AS full_line,
           regexp_extract(trim_value, '^([^,]*),([^,]*),(.*)$', ['a', 'b', 'c'], 's') AS f
    FROM (SELECT *, regexp_replace(value, '^{PAD}+|{PAD}+$', '', 'g') AS trim_value FROM lines))),
typed AS (
  SELECT line_no, value, full_line, CASE WHEN regexp_full_match(a, '[+-]?[0-9]+') THEN TRY_CAST(a AS BIGINT) END AS event_ts,
         CASE WHEN regexp_full_match(b, '[+-]?[0-9]+') THEN TRY_CAST(b AS BIGINT) END AS log_id, c AS content
  FROM split)"""


FEED = f"""{LOG}, feed AS (SELECT *, dense_rank() OVER (ORDER BY arrival_ts // {FEED_SLICE}) - 1 AS slice FROM log),
tops AS (SELECT slice, max(event_ts) AS top FROM feed GROUP BY slice),
seen AS (
  SELECT slice, max(top) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
         max(top) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS before2,
         max(top) OVER (ORDER BY slice ROWS UNBOUNDED PRECEDING) AS upto
  FROM tops)"""


def feed_pairs(kind: str) -> str:
    return f"""feed_pairs AS (
  SELECT feed.*, before, before2, {last_end(kind)} AS last_end, {last_end(kind)} - k * {SLIDE[kind]} AS window_end
  FROM feed JOIN seen USING (slice), range({SIZE // SLIDE[kind]}) AS steps(k))"""


def native(kind: str) -> str:
    return f"""WITH {FEED}, {feed_pairs(kind)}, counts AS (
  SELECT log_id % {LANES} AS task_id, window_end, count(*) AS count_actual, min(log_id) AS min_id, max(log_id) AS max_id
  FROM feed_pairs WHERE NOT coalesce(window_end <= before2 - {LAG}, false) GROUP BY ALL)
SELECT task_id * 1001 AS key, window_end, count_actual, min_id, max_id, max_id - min_id + 1 AS count_expected,
       max_id - min_id + 1 - count_actual AS loss_network
FROM counts WHERE window_end <= (SELECT max(top) FROM tops) - {LAG}"""


SPLIT_LATE = f"coalesce(last_end + {LAG} <= before, false)"
SPLIT_CLOSED = f"coalesce(window_end + {LAG} <= before, false)"
SPLIT_WINDOWS = f"""split_counts AS (
  SELECT log_id % {LANES} AS task_id, window_end, count(*) AS count_actual, min(log_id) AS min_id, max(log_id) AS max_id
  FROM feed_pairs WHERE NOT {SPLIT_CLOSED} GROUP BY ALL),
split_windows AS (
  SELECT c.*, min(s.upto) - {LAG} - 1 AS current_wm
  FROM split_counts c JOIN seen s ON c.window_end + {LAG} <= s.upto GROUP BY ALL)"""

METRIC_COLUMNS = """window_type, lag_ms, task_id, key, window_end, trigger_ts, count_actual, count_expected,
  loss_network, count_expected_stride, loss_stride, lag_system, current_wm"""


# -1 before every lane has started.
SEEN = f"coalesce(seen_ts, -1) AS seen_ts, coalesce(seen_ts - {LAG} - 1, -1) AS wm"


def _watermarks(lanes: int, by: str = "") -> str:
    first = f"{by}, " if by else ""
    return f"""WITH {LOG}, {scan(lanes, by)}
SELECT {first}log_id, event_ts, CAST(lane AS BIGINT) AS lane, {SEEN} FROM scan"""


def _late(kind: str) -> str:
    return f"""WITH {SCAN}, {lag_rows((kind,))}
SELECT lag_ms, log_id, event_ts, arrival_ts, arrival_ts - event_ts AS late_by_ms FROM scan, lags
WHERE {last_end(kind)} + lag_ms <= seen_ts"""


CURVE = f"""{LOG}, {scan(1)}, lag_rows AS (SELECT greatest(seen_ts - event_ts, 0) AS lag_ms FROM scan),
curve AS (
  SELECT i AS threshold_no, i * 5.0::DOUBLE / 49 AS threshold_s,
         count(*) FILTER (lag_ms * 49 > i * 5 * {HOUR}) AS dropped,
         count(*) FILTER (lag_ms * 49 > i * 5 * {HOUR}) / count(*) * 100 AS loss_percent
  FROM lag_rows, range(50) AS t(i) GROUP BY i)"""


def all_sql() -> dict[str, str]:
    trigger = "round(avg_trigger_delay_s, 6) AS avg_trigger_delay_s"
    sql = {}
    sql["event_lines"] = f"WITH {EVENTS} SELECT log_id, concat_ws(',', event_ts, log_id, content) AS value FROM ev"
    sql["parse_event_lines"] = f"""WITH {EVENTS}, {text_lines('ev')}
SELECT line_no, event_ts, CAST(log_id AS BIGINT) AS log_id, content FROM typed
WHERE full_line AND event_ts IS NOT NULL AND log_id IS NOT NULL"""
    sql["parse_event_rejects"] = f"""WITH {EVENTS}, {text_lines('ev')}
SELECT line_no, value, CASE WHEN NOT full_line THEN 'missing field' WHEN event_ts IS NULL THEN 'bad event_ts'
  ELSE 'bad log_id' END AS reason
FROM typed WHERE NOT full_line OR event_ts IS NULL OR log_id IS NULL"""
    sql["lane_keys"] = f"""WITH {EVENTS}
SELECT log_id % {LANES} * 1001 AS key, count(*) AS n, min(log_id) AS first_id FROM ev GROUP BY 1"""
    sql["inject_delay"] = f"WITH {LOG} SELECT log_id, event_ts, delay_ms, arrival_ts, content FROM log"
    sql["loss_sample"] = f"WITH {EVENTS} SELECT log_id, event_ts FROM ev WHERE (log_id * 31 + 7) % 100 >= 2"
    sql["delay_summary"] = f"""WITH {LOG}
SELECT source, round(sum(delay_ms) / {HOUR}.0::DOUBLE / count(*), 6) AS avg_delay_s,
       round(max(delay_ms) / {HOUR}.0::DOUBLE, 6) AS max_delay_s,
       round(count(*) FILTER (delay_ms > 2 * {HOUR}) / count(*), 6) AS share_over_2s
FROM log GROUP BY source"""
    sql["arrival_order"] = f"WITH {LOG} SELECT arrival_ts, log_id, event_ts FROM log ORDER BY arrival_ts, log_id"
    sql["replay_stats"] = f"""WITH {LOG}
SELECT source, count(*) AS "rows", round((max(arrival_ts) - min(event_ts)) / {HOUR}.0::DOUBLE, 6) AS duration_s,
       round(sum(delay_ms) / {HOUR}.0::DOUBLE / count(*), 6) AS avg_delay_s,
       round(max(delay_ms) / {HOUR}.0::DOUBLE, 6) AS max_delay_s
FROM log GROUP BY source"""
    sql["replay_file_scan"] = f"WITH {LOG} SELECT log_id, event_ts, arrival_ts, delay_ms, content FROM log"

    sql["running_max_disorder"] = f"""WITH {LOG}, {scan(1)}
SELECT log_id, seen_ts AS max_seen_ts, greatest(seen_ts - event_ts, 0) AS disorder_ms FROM scan"""
    sql["disorder_stats"] = f"""WITH {LOG}, {scan(1, 'source')}
SELECT source, count(*) AS "rows", count(*) FILTER (seen_ts > event_ts) AS out_of_order,
       round(count(*) FILTER (seen_ts > event_ts) / count(*), 6) AS out_of_order_share,
       round(max(seen_ts - event_ts) / {HOUR}.0::DOUBLE, 6) AS max_lag_s
FROM scan GROUP BY source"""
    sql["lag_loss_curve"] = f"""WITH {CURVE}
SELECT threshold_no, round(threshold_s, 6) AS threshold_s, dropped, round(loss_percent, 6) AS loss_percent FROM curve"""
    sql["loss_targets"] = f"""WITH {CURVE}
SELECT target_percent, round(threshold_s, 6) AS threshold_s, round(loss_percent, 6) AS loss_percent FROM (
  SELECT *, row_number() OVER (PARTITION BY target_percent
                               ORDER BY abs(loss_percent - target_percent), threshold_no) AS place
  FROM curve, (VALUES (1.0::DOUBLE), (5.0::DOUBLE)) AS t(target_percent)) WHERE place = 1"""
    sql["disorder_p99"] = f"""WITH {LOG}, {scan(1, 'source')}
SELECT source, round(quantile_cont(greatest(seen_ts - event_ts, 0)::DOUBLE, 0.99) / {HOUR}, 6) AS disorder_s
FROM scan GROUP BY source"""
    sql["traffic_density"] = f"""WITH {LOG}, firsts AS (
  SELECT source, min(arrival_ts) AS first_ts, max(arrival_ts) AS last_ts FROM log GROUP BY source),
grid AS (SELECT source, unnest(range((last_ts - first_ts) // {HOUR} + 1)) AS second FROM firsts),
counts AS (
  SELECT source, (arrival_ts - first_ts) // {HOUR} AS second, count(*) AS n
  FROM log JOIN firsts USING (source) GROUP BY ALL)
SELECT source, second, coalesce(n, 0) AS n FROM grid LEFT JOIN counts USING (source, second)"""
    sql["delay_histogram"] = f"""WITH {LOG}, bounds AS (
  SELECT source, min(delay_ms) AS low, max(delay_ms) AS high FROM log GROUP BY source),
counts AS (
  SELECT source, least((delay_ms - low) * 50 // (high - low), 49) AS bin, count(*) AS n
  FROM log JOIN bounds USING (source) GROUP BY ALL)
SELECT source, bin, round(low + bin * (high - low) / 50.0::DOUBLE, 6) AS bin_start_ms, coalesce(n, 0) AS n
FROM (SELECT *, unnest(range(50)) AS bin FROM bounds) LEFT JOIN counts USING (source, bin)"""
    sql["delay_p99"] = f"""WITH {LOG}
SELECT source, round(quantile_cont(delay_ms::DOUBLE, 0.99) / {HOUR}, 6) AS delay_s FROM log GROUP BY source"""

    sql["disorder_profile"] = f"""WITH {LOG}, {scan(1, 'source')}, lagged AS (
  SELECT *, greatest(seen_ts - event_ts, 0) AS lag_ms FROM scan)
SELECT source, count(*) AS "rows", round(sum(delay_ms) / {HOUR}.0::DOUBLE / count(*), 6) AS avg_delay_s,
       round(max(delay_ms) / {HOUR}.0::DOUBLE, 6) AS max_delay_s,
       round(count(*) FILTER (delay_ms > 2 * {HOUR}) / count(*), 6) AS share_over_2s,
       round(quantile_cont(delay_ms::DOUBLE, 0.99) / {HOUR}, 6) AS p99_delay_s,
       count(*) FILTER (lag_ms > 0) AS out_of_order, round(count(*) FILTER (lag_ms > 0) / count(*), 6) AS out_of_order_share,
       round(max(lag_ms) / {HOUR}.0::DOUBLE, 6) AS max_lag_s,
       round(quantile_cont(lag_ms::DOUBLE, 0.99) / {HOUR}, 6) AS p99_lag_s
FROM lagged GROUP BY source"""

    sql["watermark_1lane"] = _watermarks(1)
    sql["watermark_3lane"] = _watermarks(LANES)
    sql["watermark_by_source"] = _watermarks(LANES, "source")
    sql["watermark_range_buckets"] = _watermarks(LANES)
    sql["watermark_resumed"] = _watermarks(LANES)
    sql["watermark_resumed_by_source"] = _watermarks(LANES, "source")
    raw = scan(LANES, "", "raw_lines")
    sql["watermark_raw_lines"] = f"""WITH {LOG}, {text_lines('log')}, raw_lines AS (
  SELECT line_no AS log_id, arrival_ts,
         CASE WHEN full_line AND typed.event_ts IS NOT NULL AND log_id IS NOT NULL THEN typed.event_ts END AS event_ts
  FROM typed JOIN (SELECT line_no, arrival_ts FROM lines) USING (line_no)), {raw}
SELECT log_id, event_ts, CAST(lane AS BIGINT) AS lane, {SEEN} FROM scan WHERE event_ts IS NOT NULL"""

    for kind in KINDS:
        sql[f"{kind}_window_metrics"] = f"WITH {SCAN}, {metric_rows((kind,))} SELECT {METRIC_COLUMNS} FROM metrics"
        sql[f"late_events_{kind}"] = _late(kind)
    sql["window_functions"] = f"""WITH {SCAN}, {metric_rows()}, spread AS (
  SELECT window_type, lag_ms, log_id % {LANES} AS task_id, window_end, round(sum(d) / count(*), 6) AS mean_delay,
         round(CAST(count(*) * sum(d * d) - sum(d) * sum(d) AS DOUBLE) / (count(*) * count(*)), 6) AS variance_delay
  FROM (SELECT *, (arrival_ts - event_ts) // {SCALE} AS d FROM pairs) JOIN lags USING (window_type) WHERE NOT {CLOSED} GROUP BY ALL)
SELECT window_type, lag_ms, task_id, key, window_end, trigger_ts, current_wm, count_actual, count_expected, loss_network,
       mean_delay, variance_delay
FROM metrics JOIN spread USING (window_type, lag_ms, task_id, window_end)"""
    sql["id_gap_loss"] = f"""WITH {LOG}, kept_log AS (
  SELECT * FROM log WHERE (log_id * 31 + 7) % 100 >= 2), {scan(LANES, '', 'kept_log')},
{metric_rows(('tumbling',), {'tumbling': [LAG]})}
SELECT task_id * 1001 AS key, window_end, count_actual, max_id - min_id + 1 AS count_expected,
       max_id - min_id + 1 - count_actual AS loss_network,
       (max_id - min_id) // {LANES} + 1 - count_actual AS loss_stride
FROM counts"""
    spans = f"""WITH {LOG}, kept_log AS (
  SELECT * FROM log WHERE (log_id * 31 + 7) % 100 >= 2), {scan(LANES, '', 'kept_log')}, {lag_rows(('tumbling',))},
placed AS (SELECT *, log_id % {LANES} AS task_id, {last_end('tumbling')} AS window_end FROM scan),
spans AS (
  SELECT task_id, window_end, low, coalesce(lead(low) OVER (PARTITION BY task_id ORDER BY window_end), high + {LANES}) AS upto
  FROM (SELECT task_id, window_end, min(log_id) AS low, max(log_id) AS high FROM placed GROUP BY ALL))"""
    sql["exact_id_gaps"] = f"""{spans}
SELECT task_id, window_end, lag_ms, any_value((upto - low) // {LANES}) AS given, count(*) FILTER (NOT {CLOSED}) AS accepted,
       count(*) FILTER ({CLOSED}) AS late, any_value((upto - low) // {LANES}) - count(*) AS lost
FROM placed JOIN spans USING (task_id, window_end), lags GROUP BY task_id, window_end, lag_ms"""
    sql["lost_ids"] = f"""{spans}
SELECT ev.log_id % {LANES} AS task_id, s.window_end, ev.log_id FROM ev
JOIN spans s ON s.task_id = ev.log_id % {LANES} AND ev.log_id >= s.low AND ev.log_id < s.upto
WHERE ev.log_id NOT IN (SELECT log_id FROM kept_log)"""
    sql["partial_miss_sliding"] = f"""WITH {SCAN}, {lag_rows(('sliding',))}, {pair_rows(('sliding',))}
SELECT lag_ms, log_id, event_ts, count(*) FILTER ({CLOSED}) AS missed FROM pairs JOIN lags USING (window_type)
GROUP BY lag_ms, log_id, event_ts, {ALL_CLOSED}
HAVING NOT {ALL_CLOSED} AND count(*) FILTER ({CLOSED}) > 0"""
    firing = f"""WITH {SCAN}, {lag_rows()}, {pair_rows()}, {STEPS},
windows AS (SELECT DISTINCT window_type, lag_ms, window_end FROM pairs JOIN lags USING (window_type)),
firing AS ({fired('windows')})"""
    sql["window_firing"] = f"""{firing}
SELECT window_type, lag_ms, window_end, trigger_ts IS NULL AS pending, coalesce(trigger_ts, -1) AS trigger_ts,
       coalesce(current_wm, -1) AS current_wm FROM firing"""
    sql["window_firing_flushed"] = f"""{firing}
SELECT window_type, lag_ms, window_end,
       coalesce(trigger_ts, (SELECT max(arrival_ts) FROM log)) AS trigger_ts,
       coalesce(current_wm, 9223372036854775807) AS current_wm FROM firing"""
    sql["window_messages"] = f"""WITH {SCAN}, {metric_rows()}
SELECT window_type, lag_ms, task_id, window_end,
       printf('{WINDOW_FORMAT}', task_id, upper(window_type), window_end, current_wm, count_actual) AS message
FROM metrics"""
    late = " UNION ALL ".join(f"SELECT '{kind}' AS window_type, * FROM ({_late(kind)})" for kind in KINDS)
    sql["late_messages"] = f"""WITH late AS ({late})
SELECT window_type, lag_ms, log_id, printf('{LATE_FORMAT}', log_id % {LANES}, log_id) AS message FROM late"""

    sql["trace_rows"] = f"WITH {SCAN}, {trace()} SELECT * FROM trace"
    sql["coded_trace_view"] = sql["trace_rows"]
    sql["coded_trace_of_lag"] = f"{sql['trace_rows']} WHERE lag_ms = {LAG}"
    all_lags = {kind: LAGS["tumbling"] for kind in KINDS}
    sql["lag_sweep"] = f"""WITH {SCAN}, {lag_rows(KINDS, all_lags)}, {pair_rows()}, sums AS (
  SELECT window_type, lag_ms, count(*) FILTER (window_end = last_end) AS events,
         count(*) FILTER (window_end = last_end AND {ALL_CLOSED}) AS late, count(*) AS pairs,
         count(*) FILTER ({CLOSED}) AS missed_pairs
  FROM pairs JOIN lags USING (window_type) GROUP BY ALL)
SELECT events, window_type, lag_ms, late, pairs, missed_pairs, round(late / events, 6) AS drop_rate_events,
       round(late / (pairs - missed_pairs + late), 6) AS drop_rate_rows,
       round(missed_pairs / pairs, 6) AS pair_loss_rate FROM sums"""
    sql["per_second_series"] = f"""WITH {SCAN}, {trace()}, {KEPT}, seconds AS (
  SELECT window_type, lag_ms, sec, count(*) AS total, count(*) FILTER (status = 'NORMAL') AS processed,
         count(*) FILTER (status = 'LATE') AS late,
         coalesce(sum(sys_ts - event_ts) FILTER (status = 'NORMAL'), 0) AS delay_ms
  FROM kept GROUP BY ALL),
grid AS (
  SELECT window_type, lag_ms, unnest(range(max(sec) + 1)) AS sec FROM seconds GROUP BY window_type, lag_ms),
dense AS (
  SELECT window_type, lag_ms, sec, coalesce(total, 0) AS total, coalesce(processed, 0) AS processed,
         coalesce(late, 0) AS late, coalesce(delay_ms, 0) AS delay_ms
  FROM grid LEFT JOIN seconds USING (window_type, lag_ms, sec))
SELECT window_type, lag_ms, sec AS relative_time_s, round(avg(total) OVER near, 6) AS throughput,
       round(avg(processed) OVER near, 6) AS processed_count,
       round(sum(late) OVER upto / sum(total) OVER upto, 6) AS drop_rate,
       round(coalesce(sum(delay_ms) OVER near / {HOUR}.0::DOUBLE / nullif(sum(processed) OVER near, 0), 0), 6)
         AS avg_delay_processed
FROM dense
WINDOW near AS (PARTITION BY window_type, lag_ms ORDER BY sec ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),
       upto AS (PARTITION BY window_type, lag_ms ORDER BY sec ROWS UNBOUNDED PRECEDING)"""
    sql["run_summary"] = f"""WITH {SCAN}, {trace()}, {KEPT}, {SUMMARY}
SELECT window_type, lag_ms, "rows", processed, late, round(drop_rate, 6) AS drop_rate,
       round(avg_latency_s, 6) AS avg_latency_s FROM summary"""
    sql["trigger_latency_summary"] = f"""WITH {SCAN}, {metric_rows()}, {WINDOW_SUMMARY}
SELECT window_type, lag_ms, windows, {trigger} FROM window_summary"""
    sql["tradeoff_table"] = f"""WITH {TRADEOFF}
SELECT window_type, lag_ms, lag_s, round(drop_rate, 6) AS drop_rate, round(avg_latency_s, 6) AS avg_latency_s, {trigger}
FROM tradeoff ORDER BY lag_ms, window_type"""
    sql["sweet_spot"] = f"""WITH {TRADEOFF}
SELECT window_type, lag_s, round(drop_rate, 6) AS drop_rate, round(avg_latency_s, 6) AS avg_latency_s, {trigger}
FROM (SELECT *, row_number() OVER (PARTITION BY window_type ORDER BY lag_ms) AS place FROM tradeoff
      WHERE drop_rate <= 0.02) WHERE place = 1"""

    sql["adaptive_lags"] = f"""WITH {ADAPTIVE_LAGS} SELECT * FROM adaptive_lags"""
    sql["adaptive_drop_rates"] = f"""WITH {ADAPTIVE}, {lag_rows(KINDS, dict.fromkeys(KINDS, [0]))}, {pair_rows()}, sums AS (
  SELECT window_type, count(*) FILTER (window_end = last_end) AS events,
         count(*) FILTER (window_end = last_end AND {ALL_CLOSED}) AS late, count(*) AS pairs,
         count(*) FILTER ({CLOSED}) AS missed_pairs
  FROM pairs JOIN lags USING (window_type) GROUP BY ALL)
SELECT events, window_type, late, pairs, missed_pairs, round(late / events, 6) AS drop_rate_events,
       round(late / (pairs - missed_pairs + late), 6) AS drop_rate_rows,
       round(missed_pairs / pairs, 6) AS pair_loss_rate FROM sums"""
    measures = ("drop_rate", "avg_latency_s", "avg_trigger_delay_s")
    sql["adaptive_tradeoff"] = f"""WITH ours AS (
  WITH {tradeoff(ADAPTIVE, dict.fromkeys(KINDS, [0]))}
  SELECT *, (SELECT sum("rows" * lag_ms)::DOUBLE / sum("rows") FROM adaptive_lags) / {HOUR} AS mean_lag_s FROM tradeoff),
fixed AS (WITH {TRADEOFF} SELECT * FROM tradeoff),
best AS (
  SELECT f.*, row_number() OVER (PARTITION BY window_type ORDER BY f.lag_ms) AS place
  FROM fixed f JOIN ours o USING (window_type) WHERE f.drop_rate <= o.drop_rate)
SELECT window_type, round(mean_lag_s, 6) AS mean_lag_s, {", ".join(f"round(o.{m}, 6) AS {m}" for m in measures)},
       round(b.lag_s, 6) AS fixed_lag_s, {", ".join(f"round(b.{m}, 6) AS fixed_{m}" for m in measures)}
FROM ours o LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (window_type)"""

    skewed_trace = f"skewed AS (SELECT *, sys_ts + {SKEW} AS skewed_ts FROM trace)"
    sql["calibrate_trace"] = f"""WITH {SCAN}, {trace()}, {skewed_trace}, {OFFSETS}
SELECT window_type, lag_ms, task_id, skewed_ts + coalesce(applied_ms, 0) AS sys_ts, event_ts, log_id, status, window_end
FROM skewed LEFT JOIN applied USING (window_type, lag_ms, task_id)"""
    skewed_metrics = f"skewed AS (SELECT *, trigger_ts + {SKEW} AS skewed_ts FROM metrics)"
    sql["calibrate_metrics"] = f"""WITH {SCAN}, {metric_rows()}, {skewed_metrics}, {OFFSETS}
SELECT window_type, lag_ms, task_id, window_end, skewed_ts + coalesce(applied_ms, 0) AS trigger_ts, count_actual,
       skewed_ts + coalesce(applied_ms, 0) - window_end AS lag_system
FROM skewed LEFT JOIN applied USING (window_type, lag_ms, task_id)"""
    sql["clock_offsets"] = f"WITH {SCAN}, {metric_rows()}, {skewed_metrics}, {OFFSETS} SELECT * FROM applied"

    sql["stored_traces"] = f"""WITH {SCAN}, {trace()}, {KEPT}, {SUMMARY}
SELECT {run_id()} AS run_id, "rows", processed, late, round(drop_rate, 6) AS drop_rate,
       round(avg_latency_s, 6) AS avg_latency_s FROM summary"""
    sql["run_names"] = f"""WITH {SCAN}, {lag_rows(KINDS, all_lags)}, {pair_rows()}
SELECT {run_id()} AS run_id, lag_ms / {HOUR}.0::DOUBLE AS lag_s, window_type AS parsed_type,
       count(*) FILTER (window_end = last_end AND {ALL_CLOSED}) AS late
FROM pairs JOIN lags USING (window_type) GROUP BY window_type, lag_ms"""
    sql["summary_texts"] = f"""WITH {TRADEOFF}
SELECT {run_id()} AS run_id, lag_s, round(round(drop_rate * 100, 2) / 100, 6) AS drop_rate,
       round(avg_latency_s, 4) AS avg_latency_s, round(avg_trigger_delay_s, 4) AS avg_trigger_delay_s, window_type
FROM tradeoff"""

    stored = f"""WITH {SCAN}, {trace()}, named AS (
  SELECT *, {run_id()} AS run_id,
         concat_ws(',', task_id, sys_ts, event_ts, log_id, content, log_id, status, window_end) AS value FROM trace)"""
    sql["stored_run_scan"] = f"""{stored}
SELECT run_id, CAST(lag_ms * 1000 // {HOUR} AS BIGINT) AS lag_ms, task_id AS file_task, task_id, sys_ts, event_ts, log_id,
       content || ',' || log_id AS content, status, window_end FROM named"""
    sql["stored_run_rejects"] = f"""{stored}
SELECT run_id, CASE WHEN log_id % 2 = 0 THEN concat_ws(',', task_id, sys_ts, event_ts)
                    ELSE regexp_replace(value, '^([0-9]+,)', '\\1x') END AS value,
       CASE WHEN log_id % 2 = 0 THEN 'number of fields' ELSE 'bad sys_ts' END AS reason
FROM named WHERE log_id % 97 = 0"""
    names = run_id().replace("klag-all-data-trace", "klag-window_Tumbling")
    sql["stored_metric_scan"] = f"""WITH {SCAN}, {metric_rows()}
SELECT {names} AS run_id, CAST(lag_ms * 1000 // {HOUR} AS BIGINT) AS lag_ms, task_id AS file_task, task_id, window_end, trigger_ts,
       count_actual, count_expected, loss_network, lag_system, current_wm FROM metrics"""
    sql["run_discovery"] = f"{stored} SELECT DISTINCT run_id FROM named"
    sql["selected_run"] = f"""{stored}
SELECT run_id, task_id AS file_task, status, count(*) AS n FROM named
WHERE run_id = (SELECT max(run_id) FROM named) GROUP BY ALL"""
    sql["metric_sink"] = f"""WITH {SCAN}, {metric_rows()}
SELECT {run_id()} AS run_id, window_end, trigger_ts, count_actual, count_expected, loss_network, lag_system, current_wm
FROM metrics"""
    sql["series_sink"] = sql["per_second_series"].replace("SELECT window_type, lag_ms, sec AS relative_time_s", f"SELECT {run_id()} AS run_id, sec AS relative_time_s")
    sql["tradeoff_sink"] = f"""WITH {TRADEOFF}
SELECT {run_id()} AS "Experiment", lag_s AS "Lag", round(drop_rate, 6) AS "DropRate", round(avg_latency_s, 6) AS "AvgLatency",
       round(avg_trigger_delay_s, 6) AS "TriggerDelay",
       CASE window_type WHEN 'tumbling' THEN 'Tumbling Window' ELSE 'Sliding Window' END AS "Type" FROM tradeoff"""
    sql["calibrated_rewrite"] = sql["calibrate_metrics"]

    for kind in KINDS:
        sql[f"stream_{kind}_metrics"] = native(kind)
    def both(part) -> str:
        """The same query for both window types."""
        return " UNION ALL ".join(f"SELECT '{kind}' AS window_type, * FROM ({part(kind)})" for kind in KINDS)

    sql["stream_late_events"] = both(lambda kind: f"""WITH {FEED}
SELECT log_id, event_ts, slice AS batch_id, before - {LAG} - 1 AS current_wm
FROM feed JOIN seen USING (slice) WHERE {last_end(kind)} + {LAG} <= before""")
    sql["stream_late_sweep"] = " UNION ALL ".join(f"""SELECT '{kind}' AS window_type, {lag}::BIGINT AS lag_ms, * FROM (WITH {FEED}
SELECT log_id, event_ts, slice AS batch_id, before - {lag} - 1 AS current_wm
FROM feed JOIN seen USING (slice) WHERE {last_end(kind)} + {lag} <= before)""" for kind in KINDS for lag in LAGS[kind])
    sql["stream_stateful_late"] = both(lambda kind: f"""WITH {FEED}
SELECT log_id, event_ts, before - {LAG} - 1 AS current_wm
FROM feed JOIN seen USING (slice) WHERE {last_end(kind)} + {LAG} <= before""")
    sql["stream_split_windows"] = both(lambda kind: f"""WITH {FEED}, {feed_pairs(kind)}, {SPLIT_WINDOWS}
SELECT task_id * 1001 AS key, window_end, count_actual, min_id, max_id, max_id - min_id + 1 AS count_expected,
       max_id - min_id + 1 - count_actual AS loss_network, current_wm FROM split_windows""")
    sql["stream_trace"] = both(lambda kind: f"""WITH {FEED}, {feed_pairs(kind)}, {SPLIT_WINDOWS}
SELECT log_id % {LANES} AS task_id, event_ts, log_id, content, 'NORMAL' AS status, window_end
FROM feed_pairs JOIN (SELECT DISTINCT window_end FROM split_windows) USING (window_end) WHERE NOT {SPLIT_CLOSED}
UNION ALL
SELECT log_id % {LANES}, event_ts, log_id, content, 'LATE', -1 FROM feed_pairs
WHERE window_end = last_end AND {SPLIT_LATE}""")
    return sql
