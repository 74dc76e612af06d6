"""Queries of trimmed estimators; iterative, so their tests compare with many starts in memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import trimmed
from epochal.registry import entry
from epochal.sources.adapters import table


def _lines(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_returnflag").alias("flag"), *[F.col(f"l_{c}").cast("double").alias(c) for c in ("quantity", "discount", "tax", "extendedprice")])


@entry("minimum_covariance")
def _(spark, d):
    return trimmed.minimum_covariance(_lines(spark, d), ["flag"], ["quantity", "extendedprice"])


@entry("trimmed_squares")
def _(spark, d):
    return trimmed.trimmed_squares(_lines(spark, d), ["flag"], ["quantity", "discount"], "extendedprice")
