"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.lineage import discard, settled


# Up to so many links the table of least neighbours, two numbers a node, goes to all tasks instead of being dealt.
BROADCAST_LINKS = 1 << 18


def _sent(least: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(least) if few else least


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(_sent(least, few), "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(_sent(least, few), "a")
    return joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Links (a, b) of comparable node ids -> (node, component): each linked node with the smallest id that it is connected to.

    Null ends are left out; repeated links and loops do no harm; no links give an empty table.  A node's neighbours are never gathered:
    each round is two aggregations joined back, so that Spark can split a node with very many links; what is known to be small is broadcast.
    """
    edges = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, count = None, edges.count()
    for _ in range(max_rounds):
        few = count <= BROADCAST_LINKS
        before, edges = edges, settled(_small_star(_large_star(edges, few), few).distinct(), "edges")
        discard(before)
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark, count = tuple(row), row[0]
    else:
        raise RuntimeError("components did not converge")
    out = settled(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), "components")
    discard(edges)
    return out
