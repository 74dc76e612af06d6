"""Ranks, quantiles and running counts without sorting a group in one task.

Rows are first counted by value (combined before the shuffle).  A group of up to WHOLE rows is one window.  The values of
a larger one are cut into BUCKETS ranges of about as many distinct values each, at approximate quantiles, so far outliers
leave no range full; sums before a value are those of the lower ranges plus those within its own, so a window holds one
range, or one row for each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS, ACCURACY = 256, 2000
"""Ranges of a group (a power of two), and the precision of their ends: of 2000 distinct values they miss by one."""

WHOLE = 1 << 14
"""Rows of a group that are ordered in one window; ends of ranges are made for larger groups only."""


def _by_size(rows: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of groups that are one window, and those of larger ones."""
    names = [F.col(b).alias(f"_g{k}") for k, b in enumerate(by)]
    large = F.broadcast(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > WHOLE).drop("_size"))  # a row for WHOLE rows at most
    same = [F.col(b).eqNullSafe(F.col(f"_g{k}")) for k, b in enumerate(by)]
    return rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")


def _cut(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ``_bucket``, the range of the row's value, found by bisection of the group's ends."""
    ends = F.percentile_approx(F.col(value).cast("double"), [k / BUCKETS for k in range(1, BUCKETS)], ACCURACY).alias("_ends")
    if by:
        cuts = rows.groupBy(*[F.col(b).alias(f"_g{k}") for k, b in enumerate(by)]).agg(ends)
        own = rows.join(cuts, [F.col(b).eqNullSafe(F.col(f"_g{k}")) for k, b in enumerate(by)], "left").drop(*[f"_g{k}" for k in range(len(by))])
    else:
        own = rows.join(F.broadcast(rows.agg(ends)), how="cross")  # one row
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(BUCKETS.bit_length() - 1))])
    below = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("_ends", at + step - 1) < F.col(value).cast("double"), step).otherwise(0))
    return own.withColumn("_bucket", below).drop("_ends")


def _with_lower(own: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Adds ``_<column>``, the sums over lower ranges, and ``<column>_all``; the group's ranges are a window of BUCKETS rows at most."""
    totals = own.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    group = by or [F.lit(0)]
    lower = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(b).alias(f"_g{k}") for k, b in enumerate(by)]
    totals = totals.select(*names, F.col("_bucket").alias("_b"), *[F.coalesce(F.sum(f"_{c}").over(lower), F.lit(0)).alias(f"_{c}") for c in columns], *[F.sum(f"_{c}").over(Window.partitionBy(*group)).alias(f"{c}_all") for c in columns])
    match = [F.col(b).eqNullSafe(F.col(f"_g{k}")) for k, b in enumerate(by)] + [F.col("_bucket") == F.col("_b")]
    return own.join(totals, match, "left").drop("_bucket", "_b", *[f"_g{k}" for k in range(len(by))])


def running(counts: DataFrame, by: list[str], value: str, columns: list[str]) -> DataFrame:
    """Adds to counts(by, value, columns), a row for each value, the sums ``<column>_before`` over smaller values and ``<column>_all`` over the group."""
    if by:
        small, counts = _by_size(counts, by)
        before, group = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
        small = small.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in columns} | {f"{c}_all": F.sum(c).over(group) for c in columns})
        return small.unionByName(_running(counts, by, value, columns))
    return _running(counts, by, value, columns)


def _running(counts: DataFrame, by: list[str], value: str, columns: list[str]) -> DataFrame:
    within = Window.partitionBy(*by, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    own = _cut(counts, by, value)
    own = _with_lower(own.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns}), by, columns)
    return own.withColumns({f"{c}_before": F.col(f"{c}_before") + F.col(f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def up_to(rows: DataFrame, by: list[str], value: str, columns: list[str]) -> DataFrame:
    """Adds ``<column>_upto``, the sums over values no larger than the row's own; values may repeat."""
    if by:
        small, rows = _by_size(rows, by)
        upto = Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return small.withColumns({f"{c}_upto": F.sum(c).over(upto) for c in columns}).unionByName(_up_to(rows, by, value, columns))
    return _up_to(rows, by, value, columns)


def _up_to(rows: DataFrame, by: list[str], value: str, columns: list[str]) -> DataFrame:
    within = Window.partitionBy(*by, "_bucket").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = _cut(rows, by, value)
    own = _with_lower(own.withColumns({f"{c}_upto": F.sum(c).over(within) for c in columns}), by, columns)
    return own.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_{c}") for c in columns}).drop(*[x for c in columns for x in (f"_{c}", f"{c}_all")])


def placed(data: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n, n_before, n_all): how often each value occurs in its group, how many values are smaller, and how many there are."""
    return running(data.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), by, value, ["n"])


def with_average_rank(data: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds tied ranks: the mean of the places that equal values take."""
    place = placed(data, by, value).select(*[F.col(b).alias(f"_r{k}") for k, b in enumerate(by)], F.col(value).alias("_v"), (F.col("n_before") + (F.col("n") + 1) / F.lit(2.0)).alias(name))
    same = [F.col(b).eqNullSafe(F.col(f"_r{k}")) for k, b in enumerate(by)] + [F.col(value) == F.col("_v")]
    return data.join(place, same, "left").drop("_v", *[f"_r{k}" for k in range(len(by))])


def quantiles(data: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by, n, names): exact quantiles with linear interpolation between the neighbouring values."""
    own = placed(data, by, value)
    at: dict[str, Column] = {}
    for name, q in shares.items():
        h = (F.col("n_all") - 1) * F.lit(float(q))
        for part, i in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            at[f"_{name}_{part}"] = F.max(F.when((F.col("n_before") <= i) & (i < F.col("n_before") + F.col("n")), F.col(value).cast("double")))
        at[f"_{name}_g"] = F.max(h - F.floor(h))
    out = own.groupBy(*by).agg(F.max("n_all").alias("n"), *[c.alias(k) for k, c in at.items()])
    return out.select(*by, "n", *[(F.col(f"_{x}_lo") + F.col(f"_{x}_g") * (F.col(f"_{x}_hi") - F.col(f"_{x}_lo"))).alias(x) for x in shares])


def at_places(data: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(by, n, names): the values at given places (1 is the smallest) of each group; a place may use the group's count ``n_all``."""
    own = placed(data, by, value)
    hit = lambda i: F.max(F.when((F.col("n_before") < i) & (i <= F.col("n_before") + F.col("n")), F.col(value).cast("double")))
    return own.groupBy(*by).agg(F.max("n_all").alias("n"), *[hit(i).alias(k) for k, i in places.items()])
