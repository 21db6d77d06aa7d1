"""Connected components by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import few_tasks, materialize, materialize_observed


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``, of any type with an order.

    The component is the smallest node reachable. In each round every node moves
    to its smallest neighbour and the links follow, so at least half of the
    nodes that are not yet done go away; groups of any size stay spread out, as
    nothing is collected by group. Rounds are cut by tables in the shared folder, in
    as many tasks as their links need.
    """
    links = links.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a < b").distinct()
    links, seen = materialize_observed(links, "links", F.count(F.lit(1)).alias("rows"))
    both = links.select("a").union(links.select("b")).distinct()
    labels, nodes = both.selectExpr("a as node", "a as component"), 2 * seen["rows"]
    while seen["rows"]:
        ends = links.union(links.select("b", "a")).toDF("node", "near")
        step = ends.groupBy("node").agg(F.min("near").alias("near"))
        step = step.selectExpr("node as component", "least(node, near) as next")
        step = materialize(few_tasks(step, 2 * seen["rows"]), "step")
        labels = labels.join(step, "component", "left").selectExpr("node", "coalesce(next, component) as component")
        labels = materialize(few_tasks(labels, nodes), "labels")
        links = links.join(step.toDF("a", "a2"), "a").join(step.toDF("b", "b2"), "b")
        links = links.selectExpr("least(a2, b2) as a", "greatest(a2, b2) as b").where("a < b").distinct()
        links, seen = materialize_observed(few_tasks(links, seen["rows"]), "links", F.count(F.lit(1)).alias("rows"))
    return labels
