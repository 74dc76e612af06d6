"""Robust location, scale, outliers and correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochal.operators import ordered


def mad_rule(data: DataFrame, by: list[str], value: str = "value", factor: float = 2.2414) -> DataFrame:
    """Adds median, mad (unscaled) and outlier: |x - median| / (mad / .6745) beyond ``factor``."""
    med = ordered.quantiles(data, by, value, {"median": 0.5}).drop("n")
    dev = data.join(med, by).withColumn("dev", F.abs(F.col(value) - F.col("median")))
    mad = ordered.quantiles(dev, by, "dev", {"mad": 0.5}).drop("n")
    return dev.join(mad, by).withColumn("outlier", F.col("dev") * 0.6745 > factor * F.col("mad")).drop("dev")


def ideal_fourths(data: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, low, high): ideal fourths, interpolated between order statistics."""
    place = F.col("n_all") / 4 + 5 / 12.0
    j, back = F.floor(place), F.col("n_all") - F.floor(place) + 1
    at = ordered.at_places(data, by, value, {"l0": j, "l1": j + 1, "h0": back, "h1": back - 1})
    g = F.col("n") / 4 + 5 / 12.0 - F.floor(F.col("n") / 4 + 5 / 12.0)
    return at.select(*by, ((1 - g) * F.col("l0") + g * F.col("l1")).alias("low"), ((1 - g) * F.col("h0") + g * F.col("h1")).alias("high"))


def carling(data: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Adds outlier by Carling's modified box plot on ideal fourths."""
    n = ordered.quantiles(data, by, value, {"median": 0.5})
    k = (17.63 * F.col("n") - 23.64) / (7.74 * F.col("n") - 3.71)
    limits = n.join(ideal_fourths(data, by, value), by).withColumn("reach", k * (F.col("high") - F.col("low")))
    return data.join(limits, by).withColumn("outlier", F.abs(F.col(value) - F.col("median")) > F.col("reach")).drop("n", "reach", "low", "high")


def bend_correlation(pairs: DataFrame, by: list[str], x: str, y: str, beta: float = 0.2) -> DataFrame:
    """Percentage bend correlation: (by, r, t, df)."""
    out = pairs
    for c in (x, y):
        w = Window.partitionBy(*by)
        med = out.groupBy(*by).agg(F.expr(f"percentile({c}, 0.5)").alias(f"_m{c}"), F.count(F.lit(1)).alias("_n"))
        out = out.drop("_n").join(med, by).withColumn("_d", F.abs(F.col(c) - F.col(f"_m{c}"))).withColumn("_i", F.row_number().over(w.orderBy("_d")))
        omega = F.max(F.when(F.col("_i") == F.floor((1 - beta) * F.col("_n") + F.lit(1e-9)), F.col("_d"))).over(w)
        out = out.withColumn("_w", omega).withColumn("_u", (F.col(c) - F.col(f"_m{c}")) / F.col("_w"))
        low, high = F.sum((F.col("_u") < -1).cast("int")).over(w), F.sum((F.col("_u") > 1).cast("int")).over(w)
        kept = F.sum(F.when(F.abs("_u") <= 1, F.col(c)).otherwise(0.0)).over(w)
        out = out.withColumn("_loc", (kept + F.col("_w") * (high - low)) / (F.col("_n") - low - high))
        out = out.withColumn(f"_b{c}", F.least(F.greatest((F.col(c) - F.col("_loc")) / F.col("_w"), F.lit(-1.0)), F.lit(1.0)))
    a, b = F.col(f"_b{x}"), F.col(f"_b{y}")
    r = out.groupBy(*by).agg((F.sum(a * b) / F.sqrt(F.sum(a * a) * F.sum(b * b))).alias("r"), (F.count(F.lit(1)) - 2).alias("df"))
    return r.withColumn("t", F.col("r") * F.sqrt(F.col("df") / (1 - F.col("r") * F.col("r"))))
