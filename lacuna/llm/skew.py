"""Joins and pairs that keep a hot key out of any single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which it counts as hot. Hot keys number at most the rows divided by this, which bounds what is broadcast.
HOT_ROWS = 100_000
#: Members of a group that stand in one block of pairs, about.
PAIR_BLOCK = 1_024


def attach(rows: DataFrame, keyed: DataFrame, key: str, n: str = "n", hot_rows: int = HOT_ROWS) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has one row per key and in ``n`` how many of ``rows`` carry it.

    Hot keys go to the rows by a broadcast, the others by a shuffle, so the rows of a hot
    key stay where they are. Rows whose key is not in ``keyed`` are dropped. ``n`` is not
    part of the result.
    """
    hot = keyed.where(F.col(n) > hot_rows).drop(n)
    if hot.isEmpty():
        return rows.join(keyed.drop(n), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.where(F.col(n) <= hot_rows).drop(n), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def group_pairs(members: DataFrame, links: DataFrame | None, key: str, group: str, a: str, b: str, block: int = PAIR_BLOCK) -> DataFrame:
    """``a, b``: every pair of members, smaller key first, of one group or of two linked groups.

    ``links`` has ``a`` and ``b``, two different groups each. The pairs are the result
    asked for and grow with the square of a group; the work does not meet in one task: a
    group is cut into blocks of about ``block`` members by the hash of the key, and a
    pair of blocks is the unit of work.
    """
    size = members.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_n"))
    m = attach(members.select(F.col(key).alias("_k"), group), size, group, "_n").withColumn("_p", F.pmod(F.xxhash64("_k"), F.col("_blocks")).cast("int"))
    own = size.where("_n > 1").select(F.col(group).alias("_a"), F.col(group).alias("_b"), F.col("_blocks").alias("_m"), F.col("_blocks").alias("_w"))
    if links is not None:
        sa, sb = size.select(F.col(group).alias("_a"), F.col("_blocks").alias("_m")), size.select(F.col(group).alias("_b"), F.col("_blocks").alias("_w"))
        own = own.unionByName(links.select(F.col("a").alias("_a"), F.col("b").alias("_b")).join(sa, "_a").join(sb, "_b").select("_a", "_b", "_m", "_w"))
    meet = own.select("_a", "_b", "_w", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_x"))
    # blocks of one group meet once, those of two groups each with each
    meet = meet.select("_a", "_b", "_x", F.explode(F.sequence(F.when(F.col("_a") == F.col("_b"), F.col("_x")).otherwise(0), F.col("_w") - 1)).alias("_y"))
    left = m.select(F.col(group).alias("_a"), F.col("_p").alias("_x"), F.col("_k").alias("_l"))
    right = m.select(F.col(group).alias("_b"), F.col("_p").alias("_y"), F.col("_k").alias("_r"))
    d = meet.join(left, ["_a", "_x"]).join(right, ["_b", "_y"]).where("_a <> _b or _x <> _y or _l < _r")
    return d.select(F.least("_l", "_r").alias(a), F.greatest("_l", "_r").alias(b))
