"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrade.session import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (x, y); component is one of its nodes.

    Each round sends every node to its least neighbour and joins the links anew
    until none is left between different nodes. Node keys are hashes, so a round
    leaves a fraction of the nodes and a long ascending chain does not occur.
    No node's links are gathered in one place: minima are partial aggregates, and
    the links of a hub are spread by the join on the table of minima. An empty
    table gives an empty table; a link of a node with itself makes it a component.
    """
    steps: list[DataFrame] = []
    while True:
        both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = cut(both.groupBy("x").agg(F.least("x", F.min("y")).alias("p")), "least")
        steps.append(least)
        moved = edges.join(least.select("x", F.col("p").alias("px")), "x").join(
            least.select(F.col("x").alias("y"), F.col("p").alias("py")), "y"
        )
        moved = moved.where("px <> py").select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y"))
        edges = cut(moved.distinct(), "links")
        if edges.isEmpty():
            break
    found = steps[0].select(F.col("x").alias("node"), F.col("p").alias("component"))
    for step in steps[1:]:
        later = step.select(F.col("x").alias("component"), "p")
        found = found.join(later, "component", "left").select("node", F.coalesce("p", "component").alias("component"))
    return found
