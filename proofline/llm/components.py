"""Connected components of an edge table, by hooking and contraction.

Every round hooks each node to its smallest neighbour, shortens the chains this makes by pointer
jumping, and replaces the ends of the edges by their roots. At least every second node that still
has an edge goes in a round, so the rounds are logarithmic in the nodes, whatever the shape of the
graph. Each step is an aggregation with a partial stage or an equality join, and is written to the
shared folder, so no node's neighbours are gathered anywhere and a lost executor re-reads files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofline.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (columns a, b); the root is the component's
    smallest node. Loops and repeated edges are allowed; nulls are ignored; no edges give no rows.
    """
    links = edges.select("a", "b").where(F.col("a") != F.col("b"))
    links = materialize(links.union(links.select("b", "a")).distinct(), "links")
    levels: list[DataFrame] = []
    while not links.isEmpty():
        roots = materialize(
            links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")),
            "hooks",
        )
        while True:
            above = roots.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            roots = materialize(
                roots.join(above, "root").select(
                    "node", F.col("higher").alias("root"), (F.col("higher") != F.col("root")).alias("moved")
                ),
                "jumps",
            )
            if roots.where("moved").isEmpty():
                break
            roots = roots.drop("moved")
        roots = roots.drop("moved")
        levels.append(roots)
        left = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = materialize(
            links.join(left, "a").join(right, "b").where("ra != rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(),
            "links",
        )
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = levels[0]
    for level in levels[1:]:
        higher = level.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        found = found.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root"))
    return found
