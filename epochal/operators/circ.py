"""Circular statistics from sums of sines and cosines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.functions.dist import binomial_lower, chi2_upper, f_upper, normal_lower, normal_quantile
from epochal.operators import pairs
from epochal.sources.shared import written


def moments(angles: DataFrame, by: list[str], a: str = "alpha", weight: str | None = None) -> DataFrame:
    """n, c, s (sums of cosines and sines) per group: everything below derives from them."""
    w = F.col(weight) if weight else F.lit(1.0)
    return angles.groupBy(*by).agg(F.sum(w).alias("n"), F.sum(w * F.cos(a)).alias("c"), F.sum(w * F.sin(a)).alias("s"))


def describe(angles: DataFrame, by: list[str], a: str = "alpha") -> DataFrame:
    """Mean direction, resultant length, variance and deviations."""
    m = moments(angles, by, a).withColumn("r", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n"))
    return m.select(*by, "n", F.atan2("s", "c").alias("mu"), "r", (1 - F.col("r")).alias("var"), F.sqrt(2 * (1 - F.col("r"))).alias("std"), F.sqrt(-2 * F.log("r")).alias("std0"))


def rayleigh(angles: DataFrame, by: list[str], a: str = "alpha") -> DataFrame:
    """z and p of the test of uniformity against one mode."""
    m = moments(angles, by, a).withColumn("r", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")))
    n, r = F.col("n"), F.col("r")
    return m.select(*by, (r * r / n).alias("z"), F.exp(F.sqrt(1 + 4 * n + 4 * (n * n - r * r)) - (1 + 2 * n)).alias("p"))


def v_test(angles: DataFrame, by: list[str], direction: float, a: str = "alpha") -> DataFrame:
    """v, u and p of the test against uniformity with a known mean direction."""
    m = moments(angles, by, a)
    v = F.col("c") * F.cos(F.lit(direction)) + F.col("s") * F.sin(F.lit(direction))
    return m.select(*by, v.alias("v"), (v * F.sqrt(2 / F.col("n"))).alias("u")).withColumn("p", 1 - normal_lower("u"))


def concentration(r: str = "r", n: str | None = "n"):
    """Kappa from the resultant length (with a count, corrected for fewer than 15 angles)."""
    x = F.col(r)
    k = F.when(x < 0.53, 2 * x + F.pow(x, F.lit(3)) + 5 * F.pow(x, F.lit(5)) / 6).when(x < 0.85, -0.4 + 1.39 * x + 0.43 / (1 - x)).otherwise(1 / (F.pow(x, F.lit(3)) - 4 * x * x + 3 * x))
    if n is None:
        return k
    small = F.when(k < 2, F.greatest(k - 2 / (F.col(n) * k), F.lit(0.0))).otherwise(F.pow(F.col(n) - 1, F.lit(3)) * k / (F.pow(F.col(n), F.lit(3)) + F.col(n)))
    return F.when((F.col(n) < 15) & (F.col(n) > 1), small).otherwise(k)


def watson_williams(angles: DataFrame, group: str, a: str = "alpha") -> DataFrame:
    """One row: F and its degrees of freedom for equal mean directions."""
    m = moments(angles, [group], a).withColumn("r", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")))
    t = m.agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("total"), F.sum("r").alias("sum_r"), F.sum("c").alias("c"), F.sum("s").alias("s"))
    t = t.withColumn("all_r", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))).withColumn("rw", F.col("sum_r") / F.col("total")).withColumn("kappa", concentration("rw", None))  # of a mean length, so without the correction for few angles
    beta = 1 + 3 / (8 * F.col("kappa"))
    between, within = F.col("sum_r") - F.col("all_r"), F.col("total") - F.col("sum_r")
    out = t.select((beta * (F.col("total") - F.col("g")) * between / ((F.col("g") - 1) * within)).alias("f"), (F.col("g") - 1).alias("df1"), (F.col("total") - F.col("g")).alias("df2"))
    return out.withColumn("p", f_upper(F.col("f"), F.col("df1").cast("double"), F.col("df2").cast("double")))


def linear_correlation(pairs: DataFrame, by: list[str], a: str = "alpha", x: str = "x") -> DataFrame:
    """Correlation of an angle with a number, and its p (chi squared with two degrees of freedom)."""
    c = pairs.withColumn("_c", F.cos(a)).withColumn("_s", F.sin(a)).groupBy(*by).agg(F.count(x).alias("n"), F.corr(x, "_s").alias("rs"), F.corr(x, "_c").alias("rc"), F.corr("_s", "_c").alias("cs"))
    rc, rs, cs = F.col("rc"), F.col("rs"), F.col("cs")
    rho = c.select(*by, "n", F.sqrt((rc * rc + rs * rs - 2 * rc * rs * cs) / (1 - cs * cs)).alias("rho"))
    return rho.select(*by, "rho", F.exp(-F.col("n") * F.col("rho") * F.col("rho") / 2).alias("p"))


def angular_correlation(pairs: DataFrame, a: str = "alpha", b: str = "beta") -> DataFrame:
    """Correlation of two angles around their means, and its p (one row)."""
    mean = pairs.agg(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a))).alias("ma"), F.atan2(F.sum(F.sin(b)), F.sum(F.cos(b))).alias("mb"))
    x, y = F.sin(F.col(a) - F.col("ma")), F.sin(F.col(b) - F.col("mb"))
    sums = pairs.join(F.broadcast(mean), how="cross").agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"), F.sum(x * x * y * y).alias("both"))  # the mean is one row
    rho = F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))
    return sums.select(rho.alias("rho"), (2 * (1 - normal_lower(F.abs(F.sqrt(F.col("xx") * F.col("yy") / F.col("both")) * rho)))).alias("p"))


def moment(angles: DataFrame, by: list[str], p: int, a: str = "alpha") -> DataFrame:
    """Length and direction of the p-th trigonometric moment."""
    m = moments(angles.withColumn("_pa", F.col(a) * p), by, "_pa")
    return m.select(*by, (F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")).alias("rho"), F.atan2("s", "c").alias("mu"))


def shape(angles: DataFrame, by: list[str], a: str = "alpha") -> DataFrame:
    """Circular skewness and kurtosis: mean sine and cosine of twice the deviation from the mean direction."""
    mean = moments(angles, by, a).select(*by, F.atan2("s", "c").alias("_mu"))
    d = F.col(a) - F.col("_mu")
    return angles.join(mean, by).groupBy(*by).agg(F.avg(F.sin(2 * d)).alias("skewness"), F.avg(F.cos(2 * d)).alias("kurtosis"))


def sample_cdf(angles: DataFrame, by: list[str], n: int, a: str = "alpha") -> DataFrame:
    """(by, bin, cdf): share of angles up to the end of each of n equal arcs of [0, 2 pi)."""
    turn = 2 * F.pi()
    own = angles.withColumn("bin", F.floor(F.pmod(F.col(a), turn) / turn * n + F.lit(1e-12)).cast("long") + 1).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("k"))
    grid = own.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))))
    w = Window.partitionBy(*by).orderBy("bin")
    return grid.join(own, [*by, "bin"], "left").withColumn("cdf", F.sum(F.coalesce("k", F.lit(0))).over(w) / F.sum(F.coalesce("k", F.lit(0))).over(Window.partitionBy(*by))).select(*by, "bin", "cdf")


def _half_circles(angles: DataFrame, by: list[str], a: str) -> DataFrame:
    """(g, v, k, n, ahead, opposite): for each distinct angle, how many lie in the open half circle after it, and how many opposite to it.

    Angles are counted by value, and the counts at the ends of the half circles come from running sums; no pairs are made.
    Angles that differ by less than 1e-8 count as equal.
    """
    turn, near = 2 * F.pi(), 1e-8
    value = written(angles.where(F.col(a).isNotNull()).groupBy(F.struct(*by).alias("g"), F.round(F.pmod(F.col(a), turn), 9).alias("v")).agg(F.count(F.lit(1)).alias("c")), "angles")
    ends = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("v") + x).alias("x")) for i, x in enumerate((F.lit(near), F.pi() - near, F.pi() + near))])
    asked = value.select("g", "v", "c", F.explode(ends).alias("e")).select("g", "v", "c", "e.i", F.pmod("e.x", turn).alias("at"), (F.col("e.x") >= turn).alias("past"))
    sizes = value.groupBy("g").agg(F.sum("c").alias("size"))
    found = pairs.reached(value, asked, ["v", "c", "i", "past"]).join(sizes, "g")
    at = lambda i: F.sum(F.when(F.col("i") == i, F.col("n") + F.when(F.col("past"), F.col("size")).otherwise(0)))
    return found.groupBy("g", "v", F.col("c").alias("k")).agg(F.max("size").alias("n"), (at(1) - at(0)).alias("ahead"), (at(2) - at(1)).alias("opposite"))


def omnibus(angles: DataFrame, by: list[str], a: str = "alpha") -> DataFrame:
    """(by, n, m, p): least count in a half circle (arcs begin at the angles) and its chance for large n."""
    half = _half_circles(angles, by, a)
    least = half.groupBy("g").agg(F.max("n").alias("n"), F.min(F.least("ahead", F.col("n") - F.col("ahead"))).alias("m"))
    big = F.pi() * F.sqrt("n") / (2.0 * (F.col("n") - 2 * F.col("m")))
    return least.select("g.*", "n", "m").withColumn("p", F.sqrt(2 * F.pi()) / big * F.exp(-F.pi() * F.pi() / (8 * big * big)))


def axial_mean(angles: DataFrame, by: list[str], m: int, a: str = "alpha") -> DataFrame:
    """(by, r, mu): resultant length and direction of m-fold symmetric angles."""
    own = moments(angles.withColumn("_ma", F.col(a) * m), by, "_ma")
    return own.select(*by, (F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")).alias("r"), (F.atan2("s", "c") / m).alias("mu"))


def confidence(angles: DataFrame, by: list[str], level: float = 0.05, a: str = "alpha") -> DataFrame:
    """(by, mu, half): mean direction and half the width of its confidence interval; null where none can be given."""
    chi2 = float(normal_quantile(np.array([1 - level / 2]))[0] ** 2)  # chi squared with one degree of freedom
    m = moments(angles, by, a).withColumn("length", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")))
    n, length = F.col("n"), F.col("length")
    wide = F.sqrt(2 * n * (2 * length * length - n * chi2) / (4 * n - chi2))
    narrow = F.sqrt(n * n - (n * n - length * length) * F.exp(chi2 / n))
    t = F.when(length / n >= 0.9, narrow).when(length / n > F.sqrt(chi2 / 2 / n), wide)
    return m.select(*by, F.atan2("s", "c").alias("mu"), F.acos(t / length).alias("half"))


def mean_test(angles: DataFrame, by: list[str], direction: float, level: float = 0.05, a: str = "alpha") -> DataFrame:
    """(by, mu, rejected): is the given direction outside the confidence interval of the mean?"""
    c = confidence(angles, by, level, a)
    away = F.abs(F.atan2(F.sin(F.lit(direction) - F.col("mu")), F.cos(F.lit(direction) - F.col("mu"))))
    return c.select(*by, "mu", (away > F.col("half")).alias("rejected"))


def equal_concentration(angles: DataFrame, group: str, first: object, second: object, a: str = "alpha") -> DataFrame:
    """One row: F (1 at least) of two groups' spreads, its degrees of freedom, the wider group's first, and p."""
    of = lambda f, g: F.sum(F.when(F.col(group) == g, f(a)))
    count = lambda g: F.sum(F.when(F.col(group) == g, 1.0))
    m = angles.agg(count(first).alias("n1"), count(second).alias("n2"), of(F.cos, first).alias("c1"), of(F.sin, first).alias("s1"), of(F.cos, second).alias("c2"), of(F.sin, second).alias("s2"))
    length = lambda k: F.sqrt(F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}"))
    m = m.withColumn("_f", (F.col("n2") - 1) * (F.col("n1") - length(1)) / ((F.col("n1") - 1) * (F.col("n2") - length(2))))
    flip = F.col("_f") <= 1
    out = m.select(F.when(flip, 1 / F.col("_f")).otherwise(F.col("_f")).alias("f"), F.when(flip, F.col("n2")).otherwise(F.col("n1")).alias("df1"), F.when(flip, F.col("n1")).otherwise(F.col("n2")).alias("df2"))
    return out.withColumn("p", 2 * f_upper("f", "df1", "df2"))


def rao_spacing(angles: DataFrame, by: list[str], a: str = "alpha") -> DataFrame:
    """(by, n, u): half the sum of the gaps' distances from equal gaps, in degrees.

    Equal angles are counted first, so the ordering runs over distinct values only; each further copy is a gap of 0.
    """
    turn = 2 * F.pi()
    value = angles.groupBy(*by, F.round(F.degrees(F.pmod(F.col(a), turn)), 9).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    gap = F.lead("v").over(Window.partitionBy(*by).orderBy("v")) - F.col("v")
    whole = Window.partitionBy(*by)
    own = value.withColumns({"n": F.sum("k").over(whole), "gap": F.coalesce(gap, 360 - F.max("v").over(whole) + F.min("v").over(whole))})
    even = 360.0 / F.col("n")
    return own.groupBy(*by).agg(F.max("n").alias("n"), (F.sum(F.abs(F.col("gap") - even) + (F.col("k") - 1) * even) / 2).alias("u"))


def kuiper(angles: DataFrame, group: str, first: object, second: object, resolution: int = 100, a: str = "alpha") -> DataFrame:
    """One row: n * m times the sum of the largest differences, either way, of two groups' distributions on a grid."""
    cdf = sample_cdf(angles.where(F.col(group).isin(first, second)), [group], resolution, a)
    side = lambda g: F.max(F.when(F.col(group) == g, F.col("cdf")))
    d = cdf.groupBy("bin").agg((side(first) - side(second)).alias("d")).agg(F.greatest(F.max("d"), F.lit(0.0)).alias("up"), F.greatest(F.max(-F.col("d")), F.lit(0.0)).alias("down"))
    n = angles.agg(F.sum(F.when(F.col(group) == first, 1.0)).alias("n"), F.sum(F.when(F.col(group) == second, 1.0)).alias("m"))
    return d.join(F.broadcast(n), how="cross").select((F.col("n") * F.col("m") * (F.col("up") + F.col("down"))).alias("k"))  # one row each


def difference(a: str, b: str):
    """Signed difference of two angles, in (-pi, pi]."""
    return F.atan2(F.sin(F.col(a) - F.col(b)), F.cos(F.col(a) - F.col(b)))


def axial(a: str, p: int):
    """Angles of p-fold symmetry on the whole circle."""
    return F.pmod(F.col(a) * p, 2 * F.pi())


def differences(left: DataFrame, right: DataFrame, key: str, a: str = "alpha") -> DataFrame:
    """(i, j, value): differences of all pairs of two stated sets of angles, one of them in blocks (see ``arrays.neighbours``)."""
    own = F.broadcast(right.select(F.col(key).alias("j"), F.col(a).alias("_b")))  # a set of conditions or means
    return left.select(F.col(key).alias("i"), F.col(a).alias("_a")).join(own, how="cross").select("i", "j", difference("_a", "_b").alias("value"))


def von_mises(angles: DataFrame, by: list[str], a: str = "alpha") -> DataFrame:
    """(by, mu, kappa): the parameters' estimates."""
    m = moments(angles, by, a).withColumn("r", F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n"))
    return m.select(*by, F.atan2("s", "c").alias("mu"), concentration("r", None).alias("kappa"))


def bessel_zero(x, terms: int = 60):
    """I0 by its series, for arguments of up to about 30."""
    half = x * x / 4
    powers = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda acc, k: F.struct((acc["term"] * half / (k * k)).alias("term"), (acc["sum"] + acc["term"] * half / (k * k)).alias("sum")))
    return powers["sum"]


def von_mises_density(data: DataFrame, a: str = "alpha", mu: str = "mu", kappa: str = "kappa") -> DataFrame:
    """Adds the density of each angle under its row's parameters."""
    return data.withColumn("density", F.exp(F.col(kappa) * F.cos(F.col(a) - F.col(mu))) / (2 * F.pi() * bessel_zero(F.col(kappa))))


def median(angles: DataFrame, by: list[str], a: str = "alpha") -> DataFrame:
    """(by, median): the angle that halves the sample, of two such (an even count) their mean direction.

    Candidates are the angles themselves (smaller first); of a candidate and its antipode the one nearer to the
    mean direction is taken.
    """
    turn = 2 * F.pi()
    half = _half_circles(angles, by, a)
    uneven = written(half.select("g", "v", "k", "n", F.abs(2 * F.col("ahead") + F.col("opposite") + F.col("k") - F.col("n")).alias("uneven")), "uneven")
    least = uneven.join(uneven.groupBy("g").agg(F.min("uneven").alias("uneven")), ["g", "uneven"]).select("g.*", "v", "k", "n")
    place = least.withColumn("before", F.sum("k").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)))
    wanted = F.when(F.col("n") % 2 == 1, 1).otherwise(2)
    taken = place.withColumn("take", F.least(F.col("k"), wanted - F.coalesce("before", F.lit(0)))).where("take > 0")
    middle = taken.groupBy(*by).agg(F.atan2(F.sum(F.col("take") * F.sin("v")), F.sum(F.col("take") * F.cos("v"))).alias("_m"))
    mean = moments(angles, by, a).select(*by, F.atan2("s", "c").alias("_mu"))
    away = F.abs(difference("_mu", "_m"))
    return middle.join(mean, by).select(*by, F.when(away > F.pi() - away, F.pmod(F.col("_m") + F.pi(), turn)).otherwise(F.col("_m")).alias("median"))


def median_test(angles: DataFrame, by: list[str], direction: float, a: str = "alpha") -> DataFrame:
    """(by, below, above, p): is the median the given direction?  Binomial, both tails."""
    own = angles.withColumn("_d", F.lit(direction)).withColumn("_d", difference(a, "_d"))
    counts = own.groupBy(*by).agg(F.sum((F.col("_d") < 0).cast("long")).alias("below"), F.sum((F.col("_d") > 0).cast("long")).alias("above"), F.count(F.lit(1)).alias("n"))
    low, high = F.least("below", "above"), F.greatest("below", "above")
    lower, upper = binomial_lower(low, F.col("n")), 1 - binomial_lower(high - 1, F.col("n"))
    return counts.withColumn("p", F.when(low == high, F.lit(1.0)).otherwise(lower + upper)).drop("n")


def symmetry_test(angles: DataFrame, by: list[str], a: str = "alpha") -> DataFrame:
    """(by, w, z, p): signed ranks of the distances from the median (normal approximation with ties; zeros go).

    Distances are counted by value first, so the ranking runs over distinct values.
    """
    d = angles.join(median(angles, by, a), by).withColumn("_d", F.round(difference(a, "median"), 9)).where("_d <> 0")
    size = d.groupBy(*by, F.abs("_d").alias("size")).agg(F.count(F.lit(1)).alias("k"), F.sum((F.col("_d") > 0).cast("long")).alias("up"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*by).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    k = F.col("k").cast("double")
    sums = size.withColumn("rank", before + (k + 1) / 2).groupBy(*by).agg(F.sum(F.col("rank") * F.col("up")).alias("w"), F.sum(k).alias("n"), F.sum(k * k * k - k).alias("ties"))
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    off = F.col("w") - n * (n + 1) / 4
    z = sums.withColumn("z", (off - 0.5 * F.signum(off)) / spread)
    return z.select(*by, "w", "z", (2 * (1 - normal_lower(F.abs("z")))).alias("p"))


def common_median_test(angles: DataFrame, group: str, a: str = "alpha") -> DataFrame:
    """One row: statistic, df and p of equal medians of several groups, and the common median."""
    common = median(angles.withColumn("_all", F.lit(1)), ["_all"], a).select("median")  # one row
    own = angles.join(F.broadcast(common), how="cross").withColumn("_d", difference(a, "median"))
    parts = own.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum((F.col("_d") < 0).cast("double")).alias("m"), F.max("median").alias("median"))
    t = parts.agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m") / F.col("n")).alias("q"), (F.count(F.lit(1)) - 1).cast("double").alias("df"), F.max("median").alias("median"))
    n, m = F.col("n"), F.col("m")
    return t.select((n * n / (m * (n - m)) * F.col("q") - n * m / (n - m)).alias("statistic"), "df", "median").withColumn("p", chi2_upper("statistic", "df"))


def two_way(angles: DataFrame, first: str, second: str, a: str = "alpha") -> DataFrame:
    """Harrison-Kanji: (effect, statistic, df1, df2, p) of two factors and their interaction.

    Concentrated samples (kappa over 2) are judged by F, others by chi squared (df2 null); one grouping-sets
    aggregate gives all resultant lengths.
    """
    sums = angles.cube(first, second).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.cos(a)).alias("c"), F.sum(F.sin(a)).alias("s"), F.grouping_id(first, second).alias("level"))
    q = (F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")
    of = lambda v, k: F.sum(F.when(F.col("level") == k, v))
    t = sums.agg(of(F.col("n"), 3).alias("n"), of(q, 3).alias("tt"), of(q, 1).alias("p2"), of(q, 2).alias("q2"), of(q, 0).alias("c2"), of(F.lit(1.0), 1).alias("p"), of(F.lit(1.0), 2).alias("q"), of(F.lit(1.0), 0).alias("cells"))
    t = t.withColumn("r", F.sqrt(F.col("tt") / F.col("n"))).withColumn("kappa", concentration("r", None))
    kappa, n, p, k = F.col("kappa"), F.col("n"), F.col("p"), F.col("q")
    main1, main2, inter = F.col("p2") - F.col("tt"), F.col("q2") - F.col("tt"), F.col("c2") - F.col("p2") - F.col("q2") + F.col("tt")
    rest_df = p * k * (n / (p * k) - 1)
    rest = (n - F.col("c2")) / rest_df
    beta = 1 / (1 - 1 / (5 * kappa) - 1 / (10 * kappa * kappa))
    half = kappa / 2
    one = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(half.alias("term"), half.alias("sum")), lambda acc, j: F.struct((acc["term"] * half * half / (j * (j + 1))).alias("term"), (acc["sum"] + acc["term"] * half * half / (j * (j + 1))).alias("sum")))["sum"]
    ratio = one / bessel_zero(kappa)
    factor = 2 / (1 - ratio * ratio)
    high = kappa > 2
    effects = [("first", main1, p - 1, beta, 2.0), ("second", main2, k - 1, beta, 2.0), ("interaction", inter, (p - 1) * (k - 1), F.lit(1.0), 1.0)]
    rows = [F.struct(F.lit(name).alias("effect"), F.when(high, b * e / df / rest).otherwise(factor * e).alias("statistic"), F.when(high, df).otherwise(df * times).alias("df1"), F.when(high, rest_df).alias("df2")) for name, e, df, b, times in effects]
    out = t.select(F.explode(F.array(*rows)).alias("e")).select("e.*")
    return out.withColumn("p", F.when(F.col("df2").isNotNull(), f_upper("statistic", "df1", F.coalesce("df2", F.lit(1.0)))).otherwise(chi2_upper("statistic", "df1")))
