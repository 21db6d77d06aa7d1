"""Exact id gaps: which ids of a key and window never came, and which came too late.

Ids of a key are ``lanes`` apart and rise with event time. Received ids are kept as
bitmaps, so copies of a row count once, bitmaps of parts of a log are merged by an
``or``, and the ids missing are the zeros between the first and last bit.

A window answers for the ids from its own first received id up to the next window's
first one, so every id between the first and the last received of a key belongs to
exactly one window, and the losses of all windows add up to the ids given minus those
received. Ids before the first and after the last received one cannot be known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import floor_div
from tidemark.functions.parse import lane_of
from tidemark.operators.lateness import closed, window_pairs
from tidemark.operators.prefix import BLOCK, min_at_or_after
from tidemark.operators.windows import WindowSpec


STRETCH = 32_768  # bits of a bitmap of Spark
WINDOW = ["task_id", "window_end"]


def received_ids(scan: DataFrame, spec: WindowSpec, lags: list[int], lanes: int) -> DataFrame:
    """Bitmaps ``bits`` of the ids received, by key, window and the number of lags that refuse them.

    An id's ``place`` is its number in its key; a bitmap covers a ``stretch`` of 32,768
    places. It takes 4 KB, so windows should hold many ids. Tumbling windows only: an id
    has one window to answer for it.
    """
    if not spec.is_tumbling:
        raise ValueError("ids are counted by tumbling windows")
    refused = " + ".join(f"int({closed(lag)})" for lag in sorted(set(lags)))
    place = floor_div("log_id", lanes)
    rows = window_pairs(scan, spec).selectExpr(
        f"{lane_of('log_id', lanes)} as task_id", "window_end", f"{refused} as refused_by", f"{place} as place"
    )
    rows = rows.withColumn("stretch", F.expr(floor_div("place", STRETCH)))
    return rows.groupBy(*WINDOW, "refused_by", "stretch").agg(
        F.expr(f"bitmap_construct_agg(pmod(place, {STRETCH})) as bits"), F.min("place").alias("low"), F.max("place").alias("high")
    )


def merge_ids(parts: DataFrame) -> DataFrame:
    """One bitmap for each key, window, stretch and ``refused_by``, of any number of logs or days."""
    return parts.groupBy(*WINDOW, "refused_by", "stretch").agg(
        F.expr("bitmap_or_agg(bits) as bits"), F.min("low").alias("low"), F.max("high").alias("high")
    )


def _spans(received: DataFrame, block: int) -> DataFrame:
    """The places ``low <= place < upto`` that each window answers for."""
    own = received.groupBy(*WINDOW).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    starts = own.selectExpr("task_id", "low as place", "low as next_low")
    asked = own.selectExpr(*WINDOW, "low", "high", "low + 1 as place")
    found = min_at_or_after(asked, starts, ["task_id"], "place", ["next_low"], block)
    return found.selectExpr(*WINDOW, "low", "coalesce(next_low, high + 1) as upto")


def exact_gaps(received: DataFrame, lags: list[int], block: int = BLOCK) -> DataFrame:
    """Ids ``given``, ``accepted``, ``late`` and ``lost`` by key, window and lag.

    ``given`` are the ids a window answers for; late ones were refused by it, lost ones
    never came. A copy that came in time makes up for one that came late. ``received``
    is a table of ``received_ids`` for the same lags, and is read twice.
    """
    lags = sorted(set(lags))
    # The ids that a lag is the first to accept: what its bitmap adds to those before.
    upto = "bitmap_count(bitmap_or_agg(bits) over (partition by task_id, window_end, stretch order by refused_by)) as upto"
    counted = received.selectExpr(*WINDOW, "stretch", "refused_by", upto)
    before = "coalesce(lag(upto) over (partition by task_id, window_end, stretch order by refused_by), 0L)"
    added = counted.selectExpr(*WINDOW, "refused_by", f"upto - {before} as n").groupBy(*WINDOW)
    sums = [F.expr(f"coalesce(sum(if(refused_by <= {k}, n, 0L)), 0L)").alias(f"accepted_{k}") for k in range(len(lags))]
    rows = added.agg(F.sum("n").alias("came"), *sums).join(_spans(received, block), WINDOW)
    each = ", ".join(f"struct({lag}L as lag_ms, accepted_{k} as accepted)" for k, lag in enumerate(lags))
    rows = rows.selectExpr(*WINDOW, "upto - low as given", "came", f"inline(array({each}))")
    return rows.selectExpr(*WINDOW, "lag_ms", "given", "accepted", "came - accepted as late", "given - came as lost")


def lost_ids(received: DataFrame, lanes: int, block: int = BLOCK) -> DataFrame:
    """Every id that never came, with the window that answers for it.

    These are the zero bits of the merged bitmaps, between the first and the last place
    of a key. A stretch without any id is listed whole.
    """
    merged = received.groupBy("task_id", "stretch").agg(F.expr("bitmap_or_agg(bits) as bits"))
    ends = received.groupBy("task_id").agg(F.min("low").alias("first"), F.max("high").alias("last"))
    stretches = ends.selectExpr("*", f"explode(sequence({floor_div('first', STRETCH)}, {floor_div('last', STRETCH)})) as stretch")
    bytes_ = stretches.join(merged, ["task_id", "stretch"], "left").selectExpr("*", f"explode(sequence(0, {STRETCH // 8 - 1})) as byte")
    value = "coalesce(int(conv(hex(substr(bits, byte + 1, 1)), 16, 10)), 0)"
    zeros = bytes_.selectExpr("task_id", "first", "last", "stretch", "byte", f"{value} as value").where("value < 255")
    zeros = zeros.selectExpr("*", "explode(filter(sequence(0, 7), b -> getbit(value, b) = 0)) as bit")
    zeros = zeros.selectExpr("task_id", "first", "last", f"stretch * {STRETCH} + byte * 8 + bit as place")
    zeros = zeros.where("place > first and place < last").selectExpr("task_id", "-place as back")
    # The window of the id received before: the nearest start, looking back.
    starts = received.groupBy(*WINDOW).agg(F.expr("-min(low) as back")).selectExpr("task_id", "back", "-window_end as before")
    found = min_at_or_after(zeros, starts, ["task_id"], "back", ["before"], block)
    return found.selectExpr("task_id", "-before as window_end", f"-back * {lanes} + task_id as log_id")
