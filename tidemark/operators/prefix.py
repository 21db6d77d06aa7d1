"""Running aggregates and as-of lookups without a single-task window.

Every helper cuts the order into blocks, works inside each block in parallel,
and carries one row per block across block borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.arith import floor_div
from tidemark.session import lookup_join, materialize

BLOCK = 8_192


def running_sums(
    rows: DataFrame, by: list[str], order: str, cols: dict[str, str], block: int = BLOCK
) -> DataFrame:
    """Inclusive cumulative sums; ``cols`` maps a column to its running column.

    ``order`` is an integer column, unique within ``by``. ``rows`` is read twice:
    pass a table or something cheap to compute.
    """
    rows = rows.withColumn("_block", F.expr(floor_div(order, block)))
    inside = Window.partitionBy(*by, "_block").orderBy(order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*by).orderBy("_block")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*by, "_block").agg(*[F.sum(c).alias(f"_sum_{c}") for c in cols])
    carried = blocks.select(
        *by, "_block", *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_c_{c}") for c in cols]
    )
    local = rows.withColumns({new: F.sum(c).over(inside) for c, new in cols.items()})
    # One carried row a block: looked up without moving the rows again.
    joined = lookup_join(local, carried, [*by, "_block"])
    joined = joined.withColumns({new: F.col(new) + F.col(f"_c_{c}") for c, new in cols.items()})
    return joined.drop("_block", *[f"_c_{c}" for c in cols])


def min_at_or_after(
    queries: DataFrame,
    points: DataFrame,
    by: list[str],
    order: str,
    values: list[str],
    block: int = BLOCK,
) -> DataFrame:
    """For each query row: the minimum of ``values`` over points with ``order >=`` its own.

    With values that rise with ``order`` this is the next point, i.e. an as-of
    lookup, expressed as a union and a window instead of a range join. Both
    inputs are read once: their union is written out.
    """
    points = points.select(*by, order, *values).withColumn("_query", F.lit(False))
    marked = queries.withColumn("_query", F.lit(True)).unionByName(points, allowMissingColumns=True)
    marked = materialize(marked.withColumn("_block", F.expr(floor_div(order, block))), "as-of")

    # Default frame: RANGE, so points at the same order value count for a query.
    inside = Window.partitionBy(*by, "_block").orderBy(F.desc(order))
    local = marked.withColumns({v: F.min(v).over(inside) for v in values}).where("_query")

    later = Window.partitionBy(*by).orderBy(F.desc("_block"))
    later = later.rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy(*by, "_block").agg(*[F.min(v).alias(v) for v in values])
    carried = blocks.select(*by, "_block", *[F.min(v).over(later).alias(f"_later_{v}") for v in values])
    # One carried row a block: looked up without moving the rows again.
    joined = lookup_join(local, carried, [*by, "_block"])
    joined = joined.withColumns({v: F.coalesce(v, f"_later_{v}") for v in values})
    return joined.drop("_block", "_query", *[f"_later_{v}" for v in values])


def exact_percentile(rows: DataFrame, by: list[str], col: str, share: float, block: int = BLOCK) -> DataFrame:
    """Linearly interpolated percentile of an integer column, per ``by``."""
    counts = rows.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("n"))
    return percentile_of_counts(materialize(counts, "values"), by, col, share, block)


def percentile_of_counts(
    counts: DataFrame, by: list[str], col: str, share: float, block: int = BLOCK
) -> DataFrame:
    """The same from a table of distinct values and their counts ``n``.

    The values are ranked block by block, so no task ever holds all values of a
    group, let alone its rows. ``counts`` is read several times.
    """
    ranked = running_sums(counts, by, col, {"n": "_upto"}, block)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    placed = lookup_join(ranked, totals, by).withColumn("_pos", F.expr(f"(_total - 1) * {float(share)}D"))
    ends = placed.groupBy(*by).agg(
        F.expr(f"min(case when _upto - 1 >= floor(_pos) then {col} end) as _low"),
        F.expr(f"min(case when _upto - 1 >= ceil(_pos) then {col} end) as _high"),
        F.expr("max(_pos - floor(_pos)) as _part"),
    )
    return ends.selectExpr(*by, f"_low + (_high - _low) * _part as p_{col}")


def dense_range(bounds: DataFrame, last: str, name: str, block: int = BLOCK) -> DataFrame:
    """Rows ``0..last`` for every row of ``bounds``, exploded in two steps."""
    parts = bounds.selectExpr("*", f"explode(sequence(0L, {last} div {block})) as _part").repartition("_part")
    inside = f"explode(sequence(_part * {block}, least(_part * {block} + {block - 1}, {last}))) as {name}"
    return parts.selectExpr("*", inside).drop("_part")
