"""Statistics over all pairs of a group's values, without forming the pairs.

Kendall's tau counts inversions level by level: two distinct ranks part at one bit, so each pair is met once, in the
node of that bit, by a running count over the other variable.  Medians of pairwise means, small pairwise differences and
the medcouple are found by narrowing a bracket: each round counts the pairs under sixteen thresholds of every group by
running counts, until the bracket holds no more pairs of distinct values than a few times the values themselves;
these are then formed and counted.  No group is gathered in one task, but for the three of ``rank_statistics`` those of up to SMALL
rows, whose pairs numpy forms group by group: a round over many small groups would write far more than their rows.

Null values take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochal.operators import ordered
from epochal.sources.shared import written

THRESHOLDS, ROUNDS = 16, 40
"""Parts of a bracket in a round, and rounds after which what is left is formed anyway (16 ** 40 parts are beyond double precision)."""
FEW, LEAST = 4, 1 << 16
"""Pairs that are formed: this many for each distinct value, or so many in all."""

SMALL = 512
"""Rows of a group whose pairs are formed at once."""

# fixed values: factors of the Qn scale in samples of 2 to 9
SMALL_QN = {2: 0.399, 3: 0.994, 4: 0.512, 5: 0.844, 6: 0.611, 7: 0.857, 8: 0.669, 9: 0.872}


def kendall(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, tau): Kendall's tau-b; null where a variable does not vary."""
    cells = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.struct(*by).alias("g"), F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    cells = written(cells, "cells")
    tied = lambda *keys: cells.groupBy("g", *keys).agg(F.sum("c").alias("c")).groupBy("g").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias(f"t_{'_'.join(keys)}"))
    place = ordered.running(cells.select("g", "x").distinct().withColumn("one", F.lit(1)), ["g"], "x", ["one"]).select("g", "x", F.col("one_before").alias("rank"), F.col("one_all").alias("ranks"))
    levels = F.when(F.col("ranks") > 1, F.sequence(F.lit(0), F.floor(F.log2(F.col("ranks") - 1)).cast("int")))
    place = written(place, "ranks")
    split = cells.join(place, ["g", "x"]).select("g", "y", "c", "rank", F.explode(levels).alias("level"))
    high = F.expr("shiftright(rank, level) % 2 = 1")
    nodes = split.groupBy("g", "level", F.expr("shiftright(rank, level + 1)").alias("node"), "y").agg(F.sum(F.when(high, 0).otherwise(F.col("c"))).alias("low"), F.sum(F.when(high, F.col("c")).otherwise(0)).alias("high"))
    met = ordered.running(written(nodes, "nodes"), ["g", "level", "node"], "y", ["low"])
    # for a higher rank in x: lower ones with a smaller y less those with a larger y
    score = met.groupBy("g").agg(F.sum(F.col("high").cast("double") * (2 * F.col("low_before") + F.col("low") - F.col("low_all"))).alias("s"))
    n = cells.groupBy("g").agg(F.sum("c").alias("n"))
    out = n.join(tied("x"), "g").join(tied("y"), "g").join(score, "g", "left")
    every = F.col("n").cast("double") * (F.col("n") - 1) / 2
    return out.select("g.*", "n", F.try_divide(F.coalesce("s", F.lit(0.0)), F.sqrt(every - F.col("t_x")) * F.sqrt(every - F.col("t_y"))).alias("tau"))


def _values(data: DataFrame, by: list[str], value: str) -> DataFrame:
    """(g, v, c): how often each value occurs in its group."""
    return data.where(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))


def reached(values: DataFrame, probes: DataFrame, own: list[str]) -> DataFrame:
    """probes(g, at, own) with ``n``, the values no larger than ``at``, and ``d``, the distinct ones."""
    blank = [F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in own]
    rows = values.select("g", F.col("v").alias("at"), F.col("c").alias("n"), F.lit(1).cast("long").alias("d"), F.lit(False).alias("asks"), *blank)
    rows = rows.unionByName(probes.select("g", "at", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("d"), F.lit(True).alias("asks"), *own))
    return ordered.up_to(written(rows, "probes"), ["g"], "at", ["n", "d"]).where("asks").select("g", *own, F.col("n_upto").alias("n"), F.col("d_upto").alias("d"))


def select(
    values: DataFrame, askers: DataFrame, places: DataFrame, probe: Callable[[Column, Column], Column], kernel: Callable[[Column, Column], Column], more: Callable[[Column], Column] = lambda t: F.lit(0.0), extra: DataFrame | None = None
) -> DataFrame:
    """(g, at_k1, at_k2): the values at two places among kernel(v, w) of all pairs of an asker v and a value w, and of ``extra``(g, r, c).

    kernel(v, w) <= t must hold just where w <= probe(v, t).  Pairs weigh the product of their counts c.  ``places``(g, k1, k2,
    lo, hi, and what ``more`` reads) brackets both places; ``more(t)`` is added to the number of pairs up to t.
    """
    sizes = values.groupBy("g").agg(F.count(F.lit(1)).alias("_values")).join(askers.groupBy("g").agg(F.count(F.lit(1)).alias("_askers")), "g", "left")
    state = places.join(sizes, "g").withColumns({"left": F.col("_values") * F.coalesce("_askers", F.lit(0)), "n_lo": F.lit(0.0)})
    few = F.greatest(F.lit(LEAST).cast("long"), FEW * (F.col("_values") + F.coalesce("_askers", F.lit(0))))
    state = written(state.withColumn("open", F.col("left") > few), "brackets")
    for _ in range(ROUNDS):
        going = state.where("open")
        if going.isEmpty():
            break
        steps = F.explode(F.sequence(F.lit(0), F.lit(THRESHOLDS))).alias("i")
        asked = askers.join(going.select("g", "lo", "hi"), "g").select("g", "v", "c", "lo", "hi", steps)
        t = F.when(F.col("i") == THRESHOLDS, F.col("hi")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / THRESHOLDS)
        asked = asked.withColumn("t", t).select("g", "c", "t", probe(F.col("v"), F.col("t")).alias("at"))
        under = reached(values, asked, ["c", "t"]).groupBy("g", "t").agg(F.sum(F.col("c").cast("double") * F.col("n")).alias("n"), F.sum("d").alias("d")).join(going, "g")
        under = under.withColumn("n", F.col("n") + more(F.col("t")))
        found = under.groupBy("g").agg(
            F.max(F.when(F.col("n") < F.col("k1"), F.struct("t", "n", "d"))).alias("a"), F.min(F.when(F.col("n") >= F.col("k2"), F.struct("t", "d"))).alias("b"))
        state = state.join(found, "g", "left")
        closer = F.col("open") & F.col("b").isNotNull() & F.col("a").isNotNull()
        left = F.when(closer, F.col("b.d") - F.col("a.d")).otherwise(F.col("left"))
        moved = closer & ((F.col("a.t") > F.col("lo")) | (F.col("b.t") < F.col("hi")))
        state = state.select(*[c for c in places.columns if c not in ("lo", "hi")], "_values", "_askers", F.when(closer, F.col("a.t")).otherwise(F.col("lo")).alias("lo"), F.when(closer, F.col("b.t")).otherwise(F.col("hi")).alias("hi"), left.alias("left"), F.when(closer, F.col("a.n")).otherwise(F.col("n_lo")).alias("n_lo"), (moved & (left > few)).alias("open"))
        state = written(state, "brackets")
    ends = askers.join(state.select("g", "lo", "hi"), "g")
    ends = ends.select("g", "v", "c", F.explode(F.array(F.struct(F.lit(0).alias("side"), probe(F.col("v"), F.col("lo")).alias("at")), F.struct(F.lit(1).alias("side"), probe(F.col("v"), F.col("hi")).alias("at")))).alias("e"))
    spans = reached(values, ends.select("g", "v", "c", "e.side", "e.at"), ["v", "c", "side"]).groupBy("g", "v", "c").agg(F.min("d").alias("first"), F.max("d").alias("last")).where("first < last")
    index = ordered.running(values.withColumn("one", F.lit(1).cast("long")), ["g"], "v", ["one"]).select("g", F.col("v").alias("w"), F.col("c").alias("cw"), (F.col("one_before") + 1).alias("i"))
    formed = spans.select("g", "v", "c", F.explode(F.sequence(F.col("first") + 1, F.col("last"))).alias("i")).join(index, ["g", "i"])
    formed = formed.select("g", kernel(F.col("v"), F.col("w")).alias("r"), (F.col("c").cast("double") * F.col("cw")).alias("c"))
    if extra is not None:
        formed = formed.unionByName(extra.join(state.select("g", "lo", "hi"), "g").where("r > lo and r <= hi").select("g", "r", "c"))
    counts = written(formed.groupBy("g", "r").agg(F.sum("c").alias("c")), "formed")
    placed = ordered.running(counts, ["g"], "r", ["c"]).join(state.select("g", "k1", "k2", "n_lo"), "g").withColumn("below", F.col("n_lo") + F.col("c_before"))
    at = lambda k: F.max(F.when((F.col("below") < F.col(k)) & (F.col(k) <= F.col("below") + F.col("c")), F.col("r")))
    return placed.groupBy("g").agg(at("k1").alias("at_k1"), at("k2").alias("at_k2"))


def hodges_lehmann(data: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, location): the median of the means of all pairs, each value with itself included.

    Every pair is met in either order; an asker without a value meets each value once more, so pairs of a value with
    itself count twice too.
    """
    values = written(_values(data, by, value), "values")
    facts = values.groupBy("g").agg(F.sum("c").cast("double").alias("n"), F.min("v").alias("least"), F.max("v").alias("hi"))
    total = F.col("n") * (F.col("n") + 1) / 2
    twice = lambda k: (2 * k).cast("double")
    places = facts.select("g", twice(F.floor((total + 1) / 2)).alias("k1"), twice(F.ceil((total + 1) / 2)).alias("k2"), (2 * F.col("least") - F.col("hi") - 1).alias("lo"), "hi")
    askers = values.unionByName(values.select("g").distinct().select("g", F.lit(None).cast("double").alias("v"), F.lit(1).cast("long").alias("c")))
    at = select(values, askers, places, lambda v, t: F.coalesce(2 * t - v, t), lambda v, w: F.coalesce((v + w) / 2, w))
    return at.select("g.*", ((F.col("at_k1") + F.col("at_k2")) / 2).alias("location"))


def qn(data: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, qn): the Qn scale, an order statistic of the pairwise differences; null for one value."""
    values = written(_values(data, by, value), "values")
    n, c = F.sum("c"), F.col("c").cast("double")
    facts = values.groupBy("g").agg(n.alias("n"), F.sum(c * (c - 1) / 2).alias("ties"), ((n.cast("double") * n + F.sum(c * c)) / 2).alias("behind"), (F.max("v") - F.min("v")).alias("hi"))
    h = F.floor(F.col("n") / 2) + 1
    k = (h.cast("double") * (h - 1) / 2 - F.col("ties")).alias("k1")
    places = facts.where("n > 1").select("g", k, k.alias("k2"), F.lit(0.0).alias("lo"), "hi", "behind").where("k1 > 0")
    at = select(values, values, places, lambda v, t: v + t, lambda v, w: w - v, lambda t: -F.col("behind"))
    small = F.element_at(F.create_map(*[F.lit(x) for pair in SMALL_QN.items() for x in pair]), F.col("n").cast("int"))
    factor = F.coalesce(small, F.when(F.col("n") % 2 == 1, F.col("n") / (F.col("n") + 1.4)).otherwise(F.col("n") / (F.col("n") + 3.8)))
    return facts.join(at, "g", "left").select("g.*", F.when(F.col("n") > 1, 2.2219 * F.coalesce("at_k1", F.lit(0.0)) * factor).alias("qn"))


def medcouple(data: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, medcouple): a robust skewness, the median over values on either side of the median of how much farther one is than the other."""
    values = written(_values(data, by, value), "values")
    middle = ordered.quantiles(data.select(F.struct(*by).alias("g"), F.col(value).cast("double").alias("v")), ["g"], "v", {"m": 0.5}).select("g", "m")
    apart = written(values.join(middle, "g").select("g", (F.col("v") - F.col("m")).alias("v"), "c"), "apart")
    upper, lower = apart.where("v >= 0"), apart.where("v < 0").withColumn("v", -F.col("v"))
    count = lambda x: F.sum(F.when(x, F.col("c")).otherwise(0)).cast("double")
    facts = apart.groupBy("g").agg(count(F.col("v") == 0).alias("mid"), count(F.col("v") > 0).alias("up"), count(F.col("v") < 0).alias("down"))
    half, total = F.col("mid") * (F.col("mid") - 1) / 2, (F.col("up") + F.col("mid")) * (F.col("down") + F.col("mid"))
    facts = facts.withColumns({"half": half, "k1": F.floor((total + 1) / 2).cast("double"), "k2": F.ceil((total + 1) / 2).cast("double"), "lo": F.lit(-2.0), "hi": F.lit(1.0)})
    ends = {-1.0: F.col("half"), 0.0: F.col("mid"), 1.0: F.col("half") + F.col("mid") * F.col("up")}  # pairs with the median itself
    beside = facts.select("g", F.explode(F.array(*[F.struct(F.lit(r).alias("r"), c.alias("c")) for r, c in ends.items()])).alias("e")).select("g", "e.r", "e.c").where("c > 0")
    more = lambda t: sum((F.when(t >= r, c).otherwise(0.0) for r, c in ends.items()), F.lit(0.0))
    probe = lambda v, t: F.when(t >= 1, F.lit(float("inf"))).otherwise(v * (1 + t) / F.nullif(1 - t, F.lit(0.0)))
    at = select(upper, lower, facts, probe, lambda v, w: (w - v) / (w + v), more, beside)
    return at.select("g.*", ((F.col("at_k1") + F.col("at_k2")) / 2).alias("medcouple"))


def _of_group(x: np.ndarray, y: np.ndarray, has_x: np.ndarray, has_y: np.ndarray) -> tuple[float | None, float | None, float | None]:
    """(tau, location, qn) of one small group."""
    a, b, v = x[has_x & has_y], y[has_x & has_y], np.sort(x[has_x])
    n, h = len(v), len(v) // 2 + 1
    dx, dy = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
    scale = np.sqrt(np.count_nonzero(dx) / 2) * np.sqrt(np.count_nonzero(dy) / 2)
    i, j = np.triu_indices(n)
    means, gaps = (v[i] + v[j]) / 2, (v[j] - v[i])[i < j]
    middle = [(len(means) - 1) // 2, len(means) // 2]
    factor = SMALL_QN.get(n, n / (n + 1.4) if n % 2 else n / (n + 3.8))
    qn = 2.2219 * np.partition(gaps, h * (h - 1) // 2 - 1)[h * (h - 1) // 2 - 1] * factor if n > 1 else None
    return (dx * dy).sum() / 2 / scale if scale else None, np.partition(means, middle)[middle].mean() if n else None, qn


def _small_statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, tau, location, qn) of groups of up to SMALL rows(g, x, y)."""
    lists = rows.groupBy("g").agg(F.collect_list(F.struct("x", "y")).alias("own"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, own = batch.column("own").offsets.to_numpy(), batch.column("own").values
            sides = [pa.compute.struct_field(own, name) for name in ("x", "y")]
            known = [side.is_valid().to_numpy(zero_copy_only=False) for side in sides]
            x, y = (side.fill_null(0.0).to_numpy(zero_copy_only=False) for side in sides)
            out = [_of_group(*(c[lo:hi] for c in (x, y, *known))) for lo, hi in zip(ends, ends[1:])]
            columns = [pa.array([None if r[k] is None else float(r[k]) for r in out], pa.float64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), *columns], ["g", "tau", "location", "qn"])

    key = rows.schema["g"].dataType.simpleString()
    return lists.mapInArrow(found, f"g {key}, tau double, location double, qn double").where("location is not null").select("g.*", "tau", "location", "qn")


def rank_statistics(pairs: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, tau, location, qn): Kendall's tau-b of x and y, the Hodges-Lehmann location and the Qn scale of x."""
    rows = pairs.select(F.struct(*by).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    finite = lambda c: F.coalesce(F.col(c) - F.col(c), F.lit(0.0)) == 0
    apart = rows.groupBy(F.col("g").alias("_g")).agg(F.count(F.lit(1)).alias("_size"), F.min(finite("x") & finite("y")).alias("_finite"))
    apart = written(apart.where((F.col("_size") > SMALL) | ~F.col("_finite")).select("_g"), "apart")
    if apart.isEmpty():
        return _small_statistics(rows, by)
    small = _small_statistics(rows.join(apart, F.col("g").eqNullSafe(F.col("_g")), "left_anti"), by)
    pairs = pairs.join(apart, F.struct(*by).eqNullSafe(F.col("_g")), "left_semi")
    tau = kendall(pairs, by, x, y).select(F.struct(*by).alias("k"), "tau")
    scale = qn(pairs, by, x).select(F.struct(*by).alias("k"), "qn")
    large = hodges_lehmann(pairs, by, x).withColumn("k", F.struct(*by)).join(tau, "k", "left").join(scale, "k", "left").select(*by, "tau", "location", "qn")
    return small.unionByName(large)
