"""Connected components of a link table, by stars whose size no task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidewake.operators.sizing import checkpointed

MAX_ROUNDS = 60


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each pair (u, v) with the least neighbour of u. A minimum is combined before the shuffle; the join back is one that
    adaptive execution splits where one u has very many pairs."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return pairs.join(least, "u")


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Component of every vertex that has a link.

    links: table with two id columns of one type, in any order, repeated or not. Links with a null end and loops are
    ignored. Returns vertex and component (the least vertex reachable). No links give no rows.

    Each round points neighbours at the least one, first those above a vertex, then those below; rounds grow with the
    logarithm of the longest chain. Every round is written to the shared folder, so lineage stays short.
    """
    pairs = checkpointed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                         .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    digest = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = pairs.agg(digest).first()[0]
    for _ in range(MAX_ROUNDS):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = _with_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = _with_least(up)
        pairs = checkpointed(low.select("u", F.col("m").alias("v")).unionByName(
            low.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        after = pairs.agg(digest).first()[0]
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return pairs.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
