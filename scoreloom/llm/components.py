"""Connected components as joins and groupings of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edge table (src, dst): its smallest reachable node.

    Every node points to its smallest neighbour if that is smaller than itself; pointers only go
    down, so they form trees whose roots are their smallest nodes. Pointer jumping brings each node
    to its root in a logarithm of the depth; edges are then redrawn between roots. A root's
    neighbours all point down, so at least half of the nodes with edges go in each round. A node of
    very many edges is summed before it is dealt out, or is one side of a join that can be split.
    Edges with a null end and loops count for nothing.
    """
    left = stored(
        edges.where(F.col("src") != F.col("dst"))
        .select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo"))
        .distinct(),
        "edges",
    )
    labels = None
    while not left.isEmpty():
        ends = left.select(F.col("hi").alias("n"), F.col("lo").alias("p")).union(left.select("lo", "hi"))
        down = stored(ends.groupBy("n").agg(F.min("p").alias("p")).select("n", F.least("n", "p").alias("p")), "down")
        while True:
            last = down
            above = down.select(F.col("n").alias("p"), F.col("p").alias("q"))
            down = stored(down.join(above, "p").select("n", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "down")
            discard(last)
            if down.where("moved").isEmpty():
                break
        known = labels
        if known is None:
            labels = stored(down.select("n", "p"), "labels")
        else:
            root = down.select(F.col("n").alias("p"), F.col("p").alias("q"))
            labels = stored(known.join(root, "p", "left").select("n", F.coalesce("q", "p").alias("p")), "labels")
            discard(known)
        drawn = left
        for end in ("hi", "lo"):
            left = left.join(down.select(F.col("n").alias(end), F.col("p").alias("q")), end).select(
                F.col("q").alias(end), *[c for c in ("hi", "lo") if c != end]
            )
        left = stored(
            left.where(F.col("hi") != F.col("lo")).select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct(),
            "edges",
        )
        discard(drawn, down)
    if labels is None:
        return left.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    discard(left)
    return labels.select(F.col("n").alias("node"), F.col("p").alias("component"))
