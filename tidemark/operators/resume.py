"""Arrival scans that go on where an earlier one ended.

A scan needs from all rows before it only how many there were, the highest event
time of each lane, and the place of the last row. That is one row for each log: a new
day is scanned with it, and the old days are not read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.arrival_scan import ORDER, arrival_scan
from tidemark.session import lookup_join, materialize, same_keys


def scan_state(scanned: DataFrame, lanes: int, by: tuple[str, ...] = (), after: DataFrame | None = None) -> DataFrame:
    """What a later scan needs of ``scanned``, and of the state ``after`` which it went on.

    One row for each log: ``rows``, ``tops`` (the highest event time of each lane, null
    where a lane has none) and ``last`` (the place of the last row). Logs without new
    rows keep their state.
    """
    tops = [f"max(if(lane = {k}, event_ts, null)) as top_{k}" for k in range(lanes)]
    new = scanned.groupBy(*by).agg(F.count("*").alias("rows"), *[F.expr(t) for t in tops], F.expr(f"max(struct({', '.join(ORDER)})) as last"))
    if after is not None:
        new = new.unionByName(after.selectExpr(*by, "rows", *[f"tops[{k}] as top_{k}" for k in range(lanes)], "last"))
    both = new.groupBy(*by).agg(F.sum("rows").alias("rows"), *[F.max(f"top_{k}").alias(f"top_{k}") for k in range(lanes)], F.max("last").alias("last"))
    return both.where("rows > 0").selectExpr(*by, "rows", f"array({', '.join(f'top_{k}' for k in range(lanes))}) as tops", "last")


def resumed_scan(
    rows: DataFrame, after: DataFrame, lanes: int = 1, by: tuple[str, ...] = (), **options
) -> DataFrame:
    """``arrival_scan`` of rows that come after those of the state ``after``.

    The new rows are scanned by themselves. Lanes are dealt in turn from where the old
    rows left off, which only renames the lanes of the new ones: lane ``k`` of the
    new scan is lane ``(rows + k) % lanes``. Then the old tops are joined in.

    Raises if a row belongs before the last row of its log: the result would not be
    that of one scan. Rows equal to the last one may come; order between them is
    immaterial.
    """
    # A single log has one row of state, under a constant key.
    keys, one = (list(by), {}) if by else (["_log"], {"_log": F.lit(0)})
    scanned = arrival_scan(rows, lanes, by, keep_tops=True, **options).withColumns(one)
    known = after.withColumns(one).selectExpr(*keys, "rows as _rows", "tops as _tops", "last as _last")
    first = scanned.groupBy(*keys).agg(F.expr(f"min(struct({', '.join(ORDER)})) as _first"))
    early = same_keys(first, known, keys).where("_first < _last").limit(1).collect()
    if early:
        raise ValueError(f"rows come before those scanned already: {early[0]['_first']} before {early[0]['_last']}")
    joined = lookup_join(scanned, known, keys, how="left", right_rows=None if by else 1)
    # Lane k of the log is lane k - rows of the new scan.
    tops = [f"greatest(_tops[{k}], get(tops, int(pmod({k} - coalesce(_rows, 0), {lanes}))))" for k in range(lanes)]
    rest = joined.selectExpr(*rows.columns, f"int((lane + coalesce(_rows, 0)) % {lanes}) as lane", f"array({', '.join(tops)}) as _all")
    return rest.selectExpr(*rows.columns, "lane", "if(exists(_all, x -> x is null), null, array_min(_all)) as seen_ts")


def store_state(state: DataFrame, path: str) -> DataFrame:
    """Writes a state to a new path, to be read by the scan of the next day."""
    state.write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def scan_in_parts(parts: list[DataFrame], lanes: int, by: tuple[str, ...] = (), **options) -> list[DataFrame]:
    """The scans of successive parts of a log; each is written out and reads its part alone."""
    scans: list[DataFrame] = []
    state = None
    for part in parts:
        scanned = arrival_scan(part, lanes, by, **options) if state is None else resumed_scan(part, state, lanes, by, **options)
        scans.append(materialize(scanned, "scan-part"))
        state = materialize(scan_state(scans[-1], lanes, by, state), "scan-state")
    return scans
