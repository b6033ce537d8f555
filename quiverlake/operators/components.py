"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges``; ``root`` is the smallest node of its component.

    Null ends and loops are ignored; an empty edge table gives an empty result. Each round is
    two aggregations that halve the depth of the trees; the edge table is written to the
    shared folder after each round, the one before is deleted, and nothing but one count reaches the driver.
    """
    x, y = F.col(a), F.col(b)
    e = (
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
        .distinct()
    )
    e = materialise(e, "cc")
    for _ in range(most_rounds):
        # large star: every larger neighbour of a node points to the node's smallest neighbour
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        )
        # small star: every smaller neighbour and the node itself point to the smallest one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array("u", "v")).alias("w"), "m")
            .where(F.col("w") != F.col("m")).select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        )
        nxt = materialise(small, "cc")
        n_new, n_old = nxt.count(), e.count()
        same = n_new == n_old and nxt.join(e, ["u", "v"], "left_anti").isEmpty()
        discard(e)
        e = nxt
        if same or not n_new:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().join(e.select(F.col("u").alias("node")).distinct(), "node", "left_anti")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
