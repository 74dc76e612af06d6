"""Empty tables, nulls, ties and single rows of the channel and circular operators."""

import math

import pytest

from epochal.operators import circ, signals


def test_empty(spark):
    empty = spark.createDataFrame([], "g string, t_idx long, value double, alpha double")
    assert signals.rereference(empty, ["t_idx"]).count() == 0
    assert signals.resample_linear(empty, 0.5, ["g"]).count() == 0
    assert signals.outlier_trials(empty, 2.0, "g").count() == 0
    assert circ.rao_spacing(empty, ["g"]).count() == 0
    assert circ.confidence(empty, ["g"]).count() == 0


def test_resample_ends(spark):
    data = spark.createDataFrame([("a", 1, 0.0), ("a", 2, 2.0), ("a", 3, 4.0), ("b", 1, 7.0)], "g string, t_idx long, value double")
    got = sorted(map(tuple, signals.resample_linear(data, 0.5, ["g"]).collect()))
    assert got == [("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("a", 4, 4.0), ("b", 0, 7.0)]


def test_rereference_null_and_weights(spark):
    data = spark.createDataFrame([(1, 1.0, 1.0), (1, None, 1.0), (1, 4.0, 2.0), (2, 5.0, 0.0)], "t long, value double, w double")
    got = signals.rereference(data, ["t"], weight="w").collect()
    assert sorted(r["value"] for r in got if r["value"] is not None) == pytest.approx([1 - 9 / 4, 4 - 9 / 4])


def test_standard_scores_of_constant_and_nan(spark):
    data = spark.createDataFrame([("a", 2.0), ("a", 2.0), ("b", 1.0), ("b", 3.0), ("b", float("nan"))], "g string, value double")
    z = {(r["g"], r["value"]): r["z"] for r in signals.standardise(data, ["g"]).where("not isnan(value)").collect()}
    assert z["a", 2.0] is None
    assert z["b", 3.0] == pytest.approx(1 / math.sqrt(2))


def test_peak_sign_tie(spark):
    data = spark.createDataFrame([("a", 2, 3.0), ("a", 1, -3.0)], "g string, t_idx long, value double")
    assert signals.peak_sign(data, ["g"]).first()["sign"] == -1.0


def test_rao_spacing_of_copies_and_even_angles(spark):
    rows = [("even", k * math.pi / 2) for k in range(4)] + [("same", 1.0)] * 4
    got = {r["g"]: r["u"] for r in circ.rao_spacing(spark.createDataFrame(rows, "g string, alpha double"), ["g"]).collect()}
    assert got["even"] == pytest.approx(0, abs=1e-6)
    assert got["same"] == pytest.approx(270)  # one gap of 360 and three of 0, each 90 when even


def test_confidence_needs_a_direction(spark):
    rows = [("none", 0.0), ("none", math.pi), ("clear", 1.0), ("clear", 1.1), ("clear", 0.9)]
    got = {r["g"]: r["half"] for r in circ.confidence(spark.createDataFrame(rows, "g string, alpha double"), ["g"]).collect()}
    assert got["none"] is None
    assert 0 < got["clear"] < 0.3
