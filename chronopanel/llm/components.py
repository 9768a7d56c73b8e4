"""Connected components of an edge table by alternating star contractions, every step a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import dropped, sized, written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """From edges (a, b), one row (node, root): root is the least node of node's component. Nodes without an edge lack.

    Every round hangs each node's larger neighbours on its least one, then its smaller ones. Edges never become more,
    and long chains halve, so a few rounds do. Neighbours are never gathered: only their least is.
    """
    now = written(
        edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo <> hi").distinct(), "edges"
    )
    for _ in range(max_rounds if now._written[1] else 0):
        # Large star: the least of a node's neighbours and itself takes the larger neighbours over.
        up, down = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")), now.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        # Written, so that the join with a busy node's neighbours isn't bound to the partitioning of the sums.
        least = written(up.union(down).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(up.join(sized(least), "u").select("v", "m").where("v <> m").distinct(), "large")
        # Small star: of a node's smaller neighbours, the least takes the others and the node.
        smallest = written(large.groupBy("v").agg(F.min("m").alias("r")), "smallest")
        small = large.join(sized(smallest), "v").select(F.explode(F.array(F.col("v"), F.col("m"))).alias("hi"), F.col("r").alias("lo"))
        after = written(small.where("hi <> lo").select("lo", "hi").distinct(), "edges")
        dropped(now, least, large, smallest)
        now = after
        # Done when every node hangs on one root and no root hangs on another node.
        torn = now.groupBy("hi").agg(F.count("*").alias("c")).where("c > 1").select("hi")
        hung = now.select(F.col("lo").alias("hi")).distinct().join(sized(now.select("hi"), now), "hi", "left_semi")
        if torn.unionByName(hung).isEmpty():
            break
    else:
        if now._written[1]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", "lo").distinct())
