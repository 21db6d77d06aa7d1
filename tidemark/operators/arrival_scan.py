"""Watermark base of every row: what a stream job had seen when the row arrived.

A stream job with ``P`` lanes deals the arriving rows to the lanes in turn,
tracks the highest event time per lane, and takes the minimum over the lanes.
That minimum, ``seen_ts``, depends on neither the lag nor the windows:
the watermark for a lag is ``seen_ts - lag - 1``.

The running maximum is a prefix scan. Rows are cut into arrival-time buckets,
scanned per bucket in parallel, and one summary row per bucket is carried over.
If some bucket is too full (a burst, or very many equal arrival times), the cut
is made by range partitioning on the whole sort key instead, which balances the
buckets however the arrival times are distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import BROADCAST_ROWS, lookup_join, materialize, materialize_observed

ORDER = ["arrival_ts", "log_id", "event_ts"]
ROWS_PER_BUCKET = 1_000_000


def time_bucket_width(rows: DataFrame, rows_per_bucket: int) -> int:
    """Bucket width in ms that gives about ``rows_per_bucket`` rows on average."""
    low, high, n = rows.agg(F.min("arrival_ts"), F.max("arrival_ts"), F.count("*")).first()
    return 1 if not n else max(1, (high - low + 1) * rows_per_bucket // n)


def range_bucket_count(total: int, rows_per_bucket: int, parallelism: int) -> int:
    """A few buckets a task at most, however many rows: large ones sort with spills.

    The sampler behind a range partitioning needs many rows for every bound, and
    the rows carried over, one a bucket, must stay small enough to broadcast.
    """
    return max(1, min(-(-total // rows_per_bucket), 4 * parallelism, BROADCAST_ROWS // 4))


def narrower_width(bucket_ms: int, fullest: int, buckets: int, rows_per_bucket: int) -> int:
    """A width at which the fullest bucket would be full, if its rows were spread evenly.

    Unchanged if no narrower width helps or the buckets would be too many.
    """
    width = max(1, bucket_ms * rows_per_bucket // max(1, fullest))
    return width if width < bucket_ms and buckets * -(-bucket_ms // width) <= BROADCAST_ROWS else bucket_ms


def range_buckets(rows: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """Buckets of even size from a range partitioning on the sort key.

    The input partition number ends the key, so that even a large group of
    identical rows is spread over several buckets; their order is immaterial.
    The number of buckets is explicit: adaptive execution would merge them by
    bytes, and copies take few bytes. Bucket numbers must be written out before
    they are used twice.
    """
    keys = [*by, *ORDER, "_from"]
    spread = rows.withColumn("_from", F.spark_partition_id()).repartitionByRange(buckets, *keys)
    return spread.withColumn("bucket", F.spark_partition_id().cast("bigint")).drop("_from")


def _bucket_scan(rows: DataFrame, by: list[str], lanes: int) -> DataFrame:
    """Row number and per-residue running maxima inside each bucket."""
    over = f"over (partition by {', '.join([*by, 'bucket'])} order by {', '.join(ORDER)}"
    upto = f"{over} rows between unbounded preceding and current row)"
    if lanes == 1:
        return rows.selectExpr("*", f"max(event_ts) {upto} as top_0")
    rows = rows.selectExpr("*", f"bigint(row_number() {over})) - 1 as idx")
    tops = [f"max(case when idx % {lanes} = {r} then event_ts end) {upto} as top_{r}" for r in range(lanes)]
    return rows.selectExpr("*", *tops)


def _carry(summary: DataFrame, by: list[str], lanes: int) -> DataFrame:
    """What the rows of a bucket need from the buckets before it.

    In a bucket that starts at global row ``base_idx``, residue ``r`` of the local
    row number belongs to lane ``(base_idx + r) % lanes``.
    """
    partition = f"partition by {', '.join(by)}" if by else ""
    before = f"over ({partition} order by bucket rows between unbounded preceding and 1 preceding)"
    tops = f"array({', '.join(f'top_{r}' for r in range(lanes))})"
    befores = f"array({', '.join(f'before_{k}' for k in range(lanes))})"
    keys = [*by, "bucket"]
    placed = summary.selectExpr("*", f"coalesce(sum(n) {before}, 0L) as base_idx")
    dealt = [f"get({tops}, int(pmod({k} - base_idx, {lanes}))) as lane_{k}" for k in range(lanes)]
    earlier = [f"max(lane_{k}) {before} as before_{k}" for k in range(lanes)]
    carried = [f"get({befores}, int((base_idx + {r}) % {lanes})) as carry_{r}" for r in range(lanes)]
    placed = placed.selectExpr(*keys, "base_idx", *dealt).selectExpr(*keys, "base_idx", *earlier)
    return placed.selectExpr(*keys, "base_idx", *carried)


def arrival_scan(
    rows: DataFrame,
    lanes: int = 1,
    by: tuple[str, ...] = (),
    bucket_ms: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    hot_rows: int | None = None,
    keep_tops: bool = False,
) -> DataFrame:
    """Add ``seen_ts`` (null until every lane has a row) and ``lane`` to ``rows``.

    ``rows`` needs ``arrival_ts, log_id, event_ts``; select only the columns used
    later. ``by`` separates independent logs. A row without event time takes its
    turn in the dealing but moves no watermark. ``keep_tops`` also adds ``tops``, the
    highest event time of each lane so far.
    """
    by = list(by)
    parallelism = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot_rows = hot_rows or 4 * rows_per_bucket
    if bucket_ms is None:
        bucket_ms = time_bucket_width(rows, rows_per_bucket)
    for _ in range(2):
        timed = rows.withColumn("bucket", F.expr(f"arrival_ts div {bucket_ms}"))
        counted = timed.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.max("event_ts").alias("top_0"))
        histogram, found = materialize_observed(
            counted,
            "arrival-histogram",
            F.expr("coalesce(max(n), 0L) as fullest"),
            F.expr("count(1) as buckets"),
            F.expr("coalesce(sum(n), 0L) as total"),
        )
        balanced = found["fullest"] <= hot_rows
        width = narrower_width(bucket_ms, found["fullest"], found["buckets"], rows_per_bucket)
        if balanced or width == bucket_ms:
            break
        bucket_ms = width

    if balanced and lanes == 1:
        # The histogram already holds all that is carried over.
        scanned = _bucket_scan(timed, by, 1)
        carried, n_buckets = _carry(histogram, by, 1), found["buckets"]
    else:
        bucketed = timed if balanced else range_buckets(rows, by, range_bucket_count(found["total"], rows_per_bucket, parallelism))
        scanned = _bucket_scan(bucketed, by, lanes)
        scanned = materialize(scanned, "arrival-scan")
        tops = [F.max(f"top_{r}").alias(f"top_{r}") for r in range(lanes)]
        summary = scanned.groupBy(*by, "bucket").agg(F.count("*").alias("n"), *tops)
        carried, found = materialize_observed(
            _carry(summary, by, lanes), "arrival-carry", F.expr("count(1) as buckets")
        )
        n_buckets = found["buckets"]

    joined = lookup_join(scanned, carried, [*by, "bucket"], right_rows=n_buckets)
    tops = [f"greatest(top_{r}, carry_{r})" for r in range(lanes)]
    if lanes == 1:
        kept = [f"array({tops[0]}) as tops"] if keep_tops else []
        return joined.selectExpr(*rows.columns, "0 as lane", f"{tops[0]} as seen_ts", *kept)
    # Residue r of the local row number is lane (base_idx + r) % lanes.
    of_lane = ", ".join(f"get(array({', '.join(tops)}), int(pmod({k} - base_idx, {lanes})))" for k in range(lanes))
    kept = [f"array({of_lane}) as tops"] if keep_tops else []
    started = " and ".join(f"{top} is not null" for top in tops)
    return joined.selectExpr(
        *rows.columns,
        f"int((base_idx + idx) % {lanes}) as lane",
        f"case when {started} then least({', '.join(tops)}) end as seen_ts",
        *kept,
    )


# How far an event lies behind the highest event time seen so far.
DISORDER_MS = "greatest(seen_ts - event_ts, 0L)"


def watermark(lag_ms: int | str) -> str:
    return f"(seen_ts - {lag_ms} - 1)"
