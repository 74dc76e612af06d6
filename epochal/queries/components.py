"""Queries of canonical components, muscle artifacts and splines; their tests compare with whole-table arithmetic in memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from epochal.operators import arrays, canonical, trials
from epochal.registry import entry
from epochal.sources.adapters import epochs


def _halves(spark, d):
    own = epochs(spark, d).select((F.col("trial_id") % 5).alias("fold"), F.floor(F.col("trial_id") / 5).alias("t"), "x")
    return own.select("fold", "t", F.slice("x", 1, 32).alias("x")), own.select("fold", "t", F.slice("x", 33, 32).alias("y"))


@entry("canonical_cross_validated")
def _(spark, d):
    left, right = _halves(spark, d)
    return canonical.cross_validated(left, right, [0, 1, 2], 32, surrogate=True)


@entry("multiway_components")
def _(spark, d):
    own = epochs(spark, d)
    filters, _ = canonical.multiway(own, 16)
    return arrays.apply_filters(own, filters[:, :4]).select("trial_id", F.posexplode(F.transform("x", lambda v: F.abs(v))).alias("component", "magnitude"))


def _by_channel(spark, d):
    return epochs(spark, d).select(F.floor(F.col("trial_id") / 8).alias("trial"), (F.col("trial_id") % 8).alias("chan"), "x")


@entry("muscle_artifacts")
def _(spark, d):
    return trials.muscle_artifacts(_by_channel(spark, d), 500.0, 2.5, padding=4, seconds=0.02)


@entry("trial_splines")
def _(spark, d):
    return trials.spline(epochs(spark, d), 64.0, 8, 55).select("trial_id", F.posexplode("x").alias("t", "value"))
