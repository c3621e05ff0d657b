"""Connected components over an edge table, by min-label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import kept, remove


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """Label every node that has an edge with the smallest id of its component.

    Returns ``(node, component)``. Nodes without an edge are not listed. Alternating
    large-star and small-star steps contract the graph, so the number of rounds grows
    with the logarithm of the longest path. A node with a third of all edges is a key of
    a partial ``min``, and of a join with its minimum, whose partition adaptive execution
    splits. Self-loops and repeated edges are
    ignored, null ends dropped; no edges give no rows. The edges of a round are deleted after
    the next. Raises if ``max_rounds`` rounds
    do not suffice.
    """
    u = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e, folder = kept(u.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        m2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(m2, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u <> v")
            .distinct()
        )
        nxt, further = kept(small)
        # Stars only: no node is both a leaf and a centre.
        open_ = nxt.join(nxt.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        remove(folder)
        e, folder = nxt, further
        if not open_:
            star = e.groupBy("u").agg(F.min("v").alias("component"))
            return star.select(F.col("u").alias("node"), "component").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
