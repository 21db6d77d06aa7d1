"""Filter interaction audit: what every filter removes in every order of the filters.

Documents are counted by the set of filters they fail (a mask). In the orders of the
filters, listed lexicographically, those in which a mask is removed at a given step
form a few intervals of ranks: a prefix of filters it passes, then one it fails, with
any rest. The count of a mask is added at the start of each interval and taken off at
its end, and one running sum over the ranks gives the removals of all orders.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.session import materialize

# Filters in the order of their bits: A is bit 0.
FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))

# Words of ``text``: maximal runs of other characters than the ASCII blanks.
WORDS = r"filter(split(text, r'[\x20\x09-\x0D]+'), w -> w <> '')"


def order_of(rank: int, filters: str = FILTERS) -> str:
    """The permutation of a lexicographic rank, by the digits of its Lehmer code."""
    left, order = list(filters), ""
    for width in range(len(left) - 1, -1, -1):
        digit, rank = divmod(rank, factorial(width))
        order += left.pop(digit)
    return order


def rank_of(prefix: str, filters: str = FILTERS) -> int:
    """Rank of the first permutation that starts with ``prefix``."""
    left, rank = list(filters), 0
    for f in prefix:
        rank += left.index(f) * factorial(len(left) - 1)
        left.remove(f)
    return rank


def intervals(filters: str = FILTERS) -> list[tuple[int, int, int, int]]:
    """``(mask, step, first, end)``: ranks whose orders remove the mask at the step.

    Neighbouring intervals of a mask and step are one.
    """
    found = []
    for mask in range(1, 1 << len(filters)):
        failed = [f for k, f in enumerate(filters) if mask >> k & 1]
        passed = [f for f in filters if f not in failed]
        for step in range(1, len(passed) + 2):
            starts = sorted(rank_of("".join(p) + f) for p in permutations(passed, step - 1) for f in failed)
            width, spans = factorial(len(filters) - step), []
            for start in starts:
                if spans and spans[-1][1] == start:
                    spans[-1][1] = start + width
                else:
                    spans.append([start, start + width])
            found += [(mask, step, first, end) for first, end in spans]
    return found


def mask_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part and mask: ``n``, and how many of them are ``good`` and ``toxic``.

    Capitals are A to Z, characters are code points; null texts count as empty ones.
    E holds for texts that a smaller id has too, wherever it is in the table; rows that
    share their id with the smallest one, and rows of a null id, are no copies. Texts
    are compared by their SHA-256. All rows of one text, part and label are added up
    before they meet, so a hot text or part is no hot key. If labels repeat, one that
    says 1 is enough.
    """
    rows = documents.selectExpr("doc_id", "coalesce(source, '') as part", "coalesce(text, '') as text")
    # The words are split once: both counts come from one struct.
    counted = rows.selectExpr("doc_id", "part", "text", f"transform(array({WORDS}), w -> struct(size(w) as n, size(array_distinct(w)) as d))[0] as words")
    passed = counted.selectExpr(
        "doc_id",
        "part",
        "unhex(sha2(text, 256)) as print",
        "int(words.n < 50) + 2 * int(100L * words.d < 65L * words.n)"
        " + 4 * int(100L * length(regexp_replace(text, '[^A-Z]+', '')) > 5L * length(text))"
        " + 8 * int(text rlike '[#$%&*|]') as mask",
    )
    known = labels.where("doc_id is not null").groupBy("doc_id")
    known = known.agg(F.expr("bool_or(quality = 1) as good"), F.expr("bool_or(toxic = 1) as toxic"))
    passed = passed.join(known, "doc_id", "left").selectExpr(
        "doc_id", "part", "print", "mask", "coalesce(good, false) as good", "coalesce(toxic, false) as toxic"
    )
    kind = ["print", "part", "mask", "good", "toxic"]
    ids = passed.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    kinds = ids.groupBy(*kind).agg(
        F.sum("n").alias("n"),
        F.expr("min(if(doc_id is null, null, struct(doc_id, n))) as low"),
        F.expr("coalesce(sum(if(doc_id is null, n, 0)), 0) as without_id"),
    )
    first = F.min("low.doc_id").over(Window.partitionBy("print"))
    kinds = kinds.withColumn("originals", F.col("without_id") + F.when(F.col("low.doc_id") == first, F.col("low.n")).otherwise(0))
    split = kinds.selectExpr("part", "good", "toxic", "inline(array(struct(mask, originals as n), struct(mask + 16 as mask, n - originals as n)))")
    return split.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.expr("sum(if(good, n, 0)) as good"), F.expr("sum(if(toxic, n, 0)) as toxic")
    )


SUMS = ("n", "good", "toxic")


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for every part, order and step; parts are the sources, null an empty one.

    Columns: ``part, filter_order, step`` and the counts ``kept`` (after the step),
    ``removed`` (by it), ``redundant`` (failing its filter, removed before),
    ``unique_fails`` (failing its filter alone), ``good_lost``, ``toxic_lost`` (removed
    by it, labelled so) and ``shapley`` (removed by its filter, over all orders). An
    empty table has no parts. Extra columns are ignored.
    """
    spark = documents.sparkSession
    masks = materialize(mask_counts(documents, labels), "masks")
    # 31 masks of at most a few dozen intervals each, whatever the data.
    spans = spark.createDataFrame(intervals(), "mask INT, step INT, first INT, end INT")
    ends = masks.join(F.broadcast(spans), "mask").selectExpr(
        "part", "step", "inline(array(struct(first as rank, n, good, toxic), struct(end as rank, -n as n, -good as good, -toxic as toxic)))"
    )
    totals = ["sum(n) as total"]
    totals += [f"sum(if(mask >> {k} & 1 = 1, n, 0)) as fails_{f}" for k, f in enumerate(FILTERS)]
    totals += [f"sum(if(mask = {1 << k}, n, 0)) as only_{f}" for k, f in enumerate(FILTERS)]
    # A filter removes a mask in as many orders as any other filter the mask fails.
    totals += [f"sum(if(mask >> {k} & 1 = 1, n * ({ORDERS} div greatest(bit_count(mask), 1)), 0)) as shapley_{f}" for k, f in enumerate(FILTERS)]
    parts = masks.groupBy("part").agg(*[F.expr(t) for t in totals])

    grid = parts.selectExpr("part", f"explode(sequence(0, {ORDERS - 1})) as rank")
    grid = grid.selectExpr("part", "rank", f"explode(sequence(1, {len(FILTERS)})) as step", *[f"0L as {c}" for c in SUMS])
    changes = ends.where(f"rank < {ORDERS}").select("part", "step", "rank", *SUMS).unionByName(grid)
    changes = changes.groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in SUMS])
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = changes.select("part", "step", "rank", *[F.sum(c).over(upto).alias(c) for c in SUMS])

    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    gone = removed.withColumn("gone", F.sum("n").over(steps))
    orders = ", ".join(f"'{order_of(rank)}'" for rank in range(ORDERS))
    named = gone.withColumn("filter_order", F.expr(f"array({orders})[rank]")).withColumn("_filter", F.expr("substr(filter_order, step, 1)"))
    of = {c: "case _filter " + " ".join(f"when '{f}' then {c}_{f}" for f in FILTERS) + " end" for c in ("fails", "only", "shapley")}
    return named.join(parts, "part").selectExpr(
        "part",
        "filter_order",
        "step",
        "total - gone as kept",
        "n as removed",
        f"{of['fails']} - n as redundant",
        f"{of['only']} as unique_fails",
        "good as good_lost",
        "toxic as toxic_lost",
        f"{of['shapley']} as shapley",
    )
