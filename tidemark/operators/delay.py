"""Turn any event table into an out-of-order arrival log.

Delays follow ``max(50 ms, LogNormal(-1, 0.8) s)``. The draw is a fixed function
of the event id, so every engine and every retry gives the same log.
"""

from __future__ import annotations

import math
from functools import cache
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arith import epoch_ms

# Delay model in seconds and loss rate in percent.
DELAY_MU = -1.0
DELAY_SIGMA = 0.8
MIN_DELAY_S = 0.05
LOSS_PERCENT = 2

QUANTILES = 1000


@cache
def delay_quantiles() -> tuple[int, ...]:
    """Delay in ms at the mid-points of 1000 equal probability steps.

    The table makes test logs, however long: its delays end at 5,116 ms.
    """
    normal = NormalDist()
    steps = ((u + 0.5) / QUANTILES for u in range(QUANTILES))
    draws = (math.exp(DELAY_MU + DELAY_SIGMA * normal.inv_cdf(p)) for p in steps)
    return tuple(round(1000 * max(MIN_DELAY_S, s)) for s in draws)


def drawn_delay_ms(event_id: str, scale: int) -> str:
    # Remainders are taken first, so that ids of any size and sign have a slot.
    low = f"pmod({event_id}, {QUANTILES})"
    high = f"pmod({event_id} div {QUANTILES} - if({event_id} < 0 and {low} <> 0, 1, 0), {QUANTILES})"
    slot = f"int(pmod({low} * 7919 + {high} * 104729, {QUANTILES}))"
    # One literal array of fixed length: no join is needed.
    return f"(bigint(get(array({', '.join(map(str, delay_quantiles()))}), {slot})) * {scale})"


def lose(events: DataFrame, percent: int = LOSS_PERCENT) -> DataFrame:
    """Loss sampling: leave out a fixed ``percent`` of the events, chosen by id."""
    return events.where(f"pmod(pmod(log_id, 100) * 31 + 7, 100) >= {percent}")


def inject_delay(events: DataFrame, scale: int = 1) -> DataFrame:
    """Add ``delay_ms`` and ``arrival_ts``; ``scale`` stretches the delays."""
    delayed = events.withColumn("delay_ms", F.expr(drawn_delay_ms("log_id", scale)))
    return delayed.withColumn("arrival_ts", F.expr("event_ts + delay_ms"))


def events_frame(
    table: DataFrame, event_id: str, ts: str, content: str, keep: tuple[str, ...] = ()
) -> DataFrame:
    """A source table as ``event_ts, log_id, content`` plus the columns to keep."""
    return table.selectExpr(
        f"{epoch_ms(ts)} as event_ts", f"bigint({event_id}) as log_id", f"{content} as content", *keep
    )


def arrival_order(rows: DataFrame) -> DataFrame:
    """Total order of the log; the id breaks ties of the arrival time."""
    return rows.orderBy("arrival_ts", "log_id")
