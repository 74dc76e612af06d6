"""Cluster permutation over any neighbourhood: grids, electrode graphs, or both at once.

Cells are whole numbers; an edge table says which are neighbours.  All replicates are tested together: cells that pass
the threshold become nodes (replicate, sign, cell), links follow from joins with the edges, and components come from
alternating star steps, in a logarithmic number of rounds whatever the clusters' shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions.dist import t_p_of
from epochal.operators import ordered
from epochal.operators.group import one_sample_t, replicate_hash, replicate_sign, two_sample_t
from epochal.sources.shared import written


def grid_edges(cells: DataFrame, cell: str = "cell", row: str = "row", col: str = "col") -> DataFrame:
    """(cell, near): the up to eight neighbours of each cell(cell, row, col) of a grid."""
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]))
    own = cells.select(F.col(cell).alias("cell"), F.col(row).alias("_r"), F.col(col).alias("_c")).distinct()
    moved = own.select("cell", "_r", "_c", steps.alias("s")).select("cell", (F.col("_r") + F.col("s.i")).alias("_r"), (F.col("_c") + F.col("s.j")).alias("_c"))
    return moved.join(own.withColumnRenamed("cell", "near"), ["_r", "_c"]).select("cell", "near")


def components(links: DataFrame) -> DataFrame:
    """(k, u, root) of each node of links(k, u, v): the smallest node that links of its own k reach.

    Large-star and small-star steps in turn; no step gathers a node's neighbours in one row.
    """
    facts = lambda df: df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("k", "u", "v").cast("decimal(38,0)")).alias("s")).first()
    now = written(links.where("u <> v").select("k", "u", "v"), "links")
    seen = facts(now)
    while seen["n"]:
        both = now.unionByName(now.select("k", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("k", "u").agg(F.min("v").alias("m")).select("k", "u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, ["k", "u"]).select("k", F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("k", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["k", "u"]).where("v <> m").select("k", F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "stars")
        before, seen = seen, facts(now)
        if before == seen:
            break
    return now.select("k", "u", F.col("v").alias("root")).unionByName(now.select("k", F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def labelled(cells: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """cells(by, cell, ..) with ``cluster``, the smallest cell that steps between neighbours of the same ``by`` reach; edges(cell, near) go both ways."""
    nodes = written(cells.withColumn("k", F.struct(*by)), "cells")
    steps = nodes.select("k", "cell").join(edges.select("cell", "near"), "cell").where("cell < near")
    links = steps.join(nodes.select("k", F.col("cell").alias("near")), ["k", "near"]).select("k", F.col("cell").alias("u"), F.col("near").alias("v"))
    root = components(links).withColumnRenamed("u", "cell")
    return nodes.join(root, ["k", "cell"], "left").withColumn("cluster", F.coalesce("root", "cell")).drop("k", "root")


def clusters(stats: DataFrame, edges: DataFrame, by: list[str], passes: Column, value: str = "t", least: int = 1) -> DataFrame:
    """(by, sign, cluster, size, mass): clusters of neighbouring cells that pass, signs apart; mass is |sum of value|."""
    cells = stats.where(passes & (F.col(value) != 0)).withColumn("sign", F.signum(value).cast("int"))
    found = labelled(cells.select(*by, "sign", "cell", F.col(value).alias("_x")), edges, [*by, "sign"]).groupBy(*by, "sign", "cluster")
    return found.agg(F.count(F.lit(1)).alias("size"), F.abs(F.sum("_x")).alias("mass")).where(F.col("size") >= least)


def _shuffled(data: DataFrame, replicates: int) -> DataFrame:
    """(rep, subject, first): whether a subject counts to the first group in a replicate; replicate 0 is as observed.

    The order of subjects in a replicate is a fixed function of both; a window holds one replicate's subjects.
    """
    subjects = data.select("subject", "first").distinct()
    reps = subjects.select("subject", "first", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("rep"))
    h = replicate_hash(F.col("rep"), F.col("subject"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.pmod(h * h, F.lit(2147483647)), "subject"))  # squared, as the orders of a linear function repeat
    n = F.sum(F.col("first").cast("long")).over(Window.partitionBy("rep"))
    return reps.select("rep", "subject", F.when(F.col("rep") == 0, F.col("first")).otherwise(place <= n).alias("first"))


def replicate_t(data: DataFrame, replicates: int, paired: bool = True, equal: bool = True) -> DataFrame:
    """(rep, cell, t, df) of data(subject, cell, value): t of sign-flipped differences, or of shuffled groups (``first`` says which)."""
    if paired:
        flipped = data.select("subject", "cell", "value", F.explode(F.sequence(F.lit(0), F.lit(replicates))).alias("rep"))
        flipped = flipped.withColumn("value", F.col("value") * replicate_sign(F.col("rep").cast("long"), F.col("subject").cast("long")))
        return one_sample_t(flipped, ["rep", "cell"]).select("rep", "cell", "t", "df")
    dealt = data.select("subject", "cell", "value").join(_shuffled(data, replicates), "subject").withColumn("side", F.when(F.col("first"), "first").otherwise("second"))
    return two_sample_t(dealt, ["rep", "cell"], "side", "first", "second", equal)


def permutation_test(
    data: DataFrame, edges: DataFrame, replicates: int, p_cell: float = 0.05, p_cluster: float = 0.05, tail: str = "both", paired: bool = True, equal: bool = True, mask: DataFrame | None = None, least: int = 1
) -> DataFrame:
    """(sign, cluster, size, mass, p, significant) of the observed clusters of data(subject, cell, value[, first]).

    p is the share of replicates whose largest cluster is heavier.  Cells outside ``mask``(cell) take no part; clusters
    under ``least`` cells do not count.  With both tails each sign has half of ``p_cluster``.
    """
    if mask is not None:
        data = data.join(mask.select("cell").distinct(), "cell", "left_semi")
    stats = replicate_t(data, replicates, paired, equal)
    passes = t_p_of(tail)(F.col("t"), F.col("df").cast("double")) < p_cell
    found = written(clusters(stats, edges, ["rep"], F.col("t").isNotNull() & passes, least=least), "clusters")
    mass = F.round("mass", 9)  # sums in another order are no heavier
    most = found.where("rep > 0").groupBy("rep").agg(F.max(mass).alias("_m")).groupBy("_m").agg(F.count(F.lit(1)).alias("n"))
    observed = found.where("rep = 0").select("sign", "cluster", "size", "mass", mass.alias("_m"))
    counts = most.unionByName(observed.select("_m", F.lit(0).cast("long").alias("n"))).groupBy("_m").agg(F.sum("n").alias("n"))
    above = ordered.running(counts, [], "_m", ["n"]).select("_m", ((F.col("n_all") - F.col("n_before") - F.col("n")) / F.lit(float(replicates))).alias("p"))
    level = p_cluster / 2 if tail == "both" else p_cluster
    return observed.join(above, "_m").select("sign", "cluster", "size", "mass", "p", (F.col("p") < level).alias("significant"))


def grid_clusters(maps: DataFrame, threshold: float) -> DataFrame:
    """(cond, sign, cluster, size, mass) of maps(cond, row, col, value): eight-connected cells beyond the threshold, numbered by their first cell in column order."""
    width = maps.agg(F.max("row").alias("most"), F.min("row").alias("least")).select((F.col("most") - F.col("least") + 1).alias("_w"), F.col("least").alias("_l"))  # one row
    cells = maps.join(F.broadcast(width), how="cross").withColumn("cell", F.col("col") * F.col("_w") + F.col("row") - F.col("_l")).drop("_w", "_l")
    found = clusters(cells.select("cond", "cell", "value"), grid_edges(cells), ["cond"], F.abs("value") > threshold, "value")
    return found.withColumn("cluster", F.row_number().over(Window.partitionBy("cond", "sign").orderBy("cluster")))
