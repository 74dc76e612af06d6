"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from epochal.llm.work import Work

SMALL = 500_000
"""Links up to which a star step broadcasts the nodes' smallest neighbours (16 bytes each); beyond, it joins by shuffle."""


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One large-star step, then one small-star step.

    Large: every larger neighbour of a node is linked to the node's smallest neighbour (itself included).
    Small: a node and its smaller neighbours are linked to the smallest of them.
    """
    sized = F.broadcast if small else lambda df: df
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.where("v > u").join(sized(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small_star = large.join(sized(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small_star.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, work: Work) -> DataFrame:
    """(u, component) for every node of the links ``edges(u, v)``; component is the smallest node reachable.

    Self links, repeated links and either direction are allowed; an empty table gives an empty table.
    Each round is one large-star and one small-star step, written out, so the plan stays short; the
    loop ends when the links no longer change, which a logarithmic number of rounds reaches.  Neither step
    gathers a node's neighbours in one row.
    """
    sums = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))

    def written(links: DataFrame, name: str) -> tuple[DataFrame, dict]:
        seen = Observation()
        return work.cut(links.observe(seen, *sums), name), seen.get

    now, before = written(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v"), "links")
    while before["n"]:
        following, after = written(_stars(now, before["n"] <= SMALL), "stars")
        work.drop_table(now)
        now = following
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
