"""Channels: bundles, averages, order, neighbours, positions; sessions and score tables that must agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: names of the 10-20 system's electrodes by region
BUNDLES = {
    "OCCIP": "PO7 PO3 O1 Iz Oz POz PO8 PO4 O2 PO9 PO10".split(),
    "PARIET": "P1 P3 P5 P7 Pz P2 P4 P6 P8".split(),
    "FRONTAL": "Fp1 AF7 AF3 Fpz Fp2 AF8 AF4 AFz Fz".split(),
    "TEMPORAL": "FT7 C5 T7 TP7 CP5 FT8 C6 T8 TP8 CP6".split(),
    "OCCIPARIET": "P1 P3 P5 P7 P9 Pz P2 P4 P6 P8 P10 PO7 PO3 O1 Iz Oz POz PO8 PO4 O2 PO9 PO10".split(),
    "CDA": "P5 P6 P7 P8 PO7 PO8 O1 O2 PO9 PO10".split(),
    "N2Pc_SPCN": "P7 P8 PO7 PO8 O1 O2 PO9 PO10".split(),
}


def labels_of(bundle: str | list[str], types: dict[str, str] | None = None) -> list[str] | None:
    """Labels of a bundle (None: all).  ``types`` names each label's kind for the bundles ALL, EEG, EOG and EEG_EOG."""
    if not isinstance(bundle, str):
        return list(bundle)
    name = bundle.upper()
    if name == "ALL_NOSELECTION":
        return None
    if name in ("ALL", "EEG", "EOG", "EEG_EOG"):
        kinds = {"ALL": ("EEG",), "EEG_EOG": ("EEG", "EOG")}.get(name, (name,))
        extra = ["HEOG_L", "HEOG_R", "EOG3", "EOG4"] if "EOG" in kinds else []
        return [label for label, kind in (types or {}).items() if kind.upper() in kinds] + extra
    found = {k.upper(): v for k, v in BUNDLES.items()}.get(name)
    if found is None:
        raise ValueError(f"no channel bundle {bundle!r}")
    return found


def select(data: DataFrame, bundle: str | list[str], types: dict[str, str] | None = None, label: str = "label") -> DataFrame:
    """Rows of the bundle's channels, as far as the data have them."""
    wanted = labels_of(bundle, types)
    return data if wanted is None else data.where(F.col(label).isin(wanted))


def select_mean(data: DataFrame, labels: list[str], by: list[str]) -> DataFrame:
    """Mean over some channels, named by all of them: (by, label, value)."""
    return select(data, labels).groupBy(*by).agg(F.avg("value").alias("value")).withColumn("label", F.lit(",".join(labels)))


def aligned(first: DataFrame, second: DataFrame) -> DataFrame:
    """(place, label, place_2): channels that both tables of (place, label) have, in the first one's order."""
    return first.select("place", "label").join(second.select("label", F.col("place").alias("place_2")), "label").select("place", "label", "place_2")


def stable_order(data: DataFrame, label: str, order: list[str]) -> DataFrame:
    """(label, place): labels numbered by their first appearance."""
    first = data.groupBy(label).agg(F.min(F.struct(*order)).alias("_first"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("_first"))).drop("_first")  # a row for each channel


def order_statistic(k: int, x: str = "x") -> Column:
    """The k-th largest channel of each row; null where there are fewer."""
    return F.try_element_at(F.sort_array(x, asc=False), F.lit(k))


def with_positions(channels: DataFrame, template: DataFrame) -> DataFrame:
    """Fills missing coordinates from a template of labels; own ones stay."""
    t = F.broadcast(template.select("label", *[F.col(c).alias(f"_{c}") for c in "xyz"]))  # one cap's electrodes
    return channels.join(t, "label", "left").select("label", *[F.coalesce(c, f"_{c}").alias(c) for c in "xyz"])


def adjacency(positions: DataFrame, reach: float) -> DataFrame:
    """(label, other) of electrodes at most ``reach`` apart, both ways; candidates come from cells of that size."""
    cell = lambda c: F.floor(F.col(c) / reach)
    own = positions.select("label", "x", "y", "z", *[cell(c).alias(f"c{c}") for c in "xyz"])
    near = own
    for c in "xyz":
        near = near.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + d for d in (-1, 0, 1)])))
    near = near.select(F.col("label").alias("other"), *[F.col(c).alias(f"_{c}") for c in "xyz"], "cx", "cy", "cz")
    square = reduce(lambda a, b: a + b, [(F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "xyz"])
    return own.join(near, ["cx", "cy", "cz"]).where((F.col("label") != F.col("other")) & (square <= reach * reach * (1 + 1e-12))).select("label", "other")


def connectivity(neighbours: DataFrame, present: DataFrame) -> DataFrame:
    """Edges (label, other) of neighbours(label, neighbours) between channels that are present, both ways."""
    edges = neighbours.select("label", F.explode("neighbours").alias("other"))
    edges = edges.unionByName(edges.select(F.col("other").alias("label"), F.col("label").alias("other"))).distinct()
    here = present.select("label").distinct()
    return edges.join(here, "label", "left_semi").join(here.select(F.col("label").alias("other")), "other", "left_semi").select("label", "other")


def merge_sessions(sessions: dict[str, DataFrame], pattern: str) -> DataFrame:
    """Trials of all sessions whose name matches, one after another, with the session's name."""
    import re

    own = [df.withColumn("session", F.lit(name)) for name, df in sorted(sessions.items()) if re.search(pattern, name)]
    if not own:
        raise ValueError(f"no session matches {pattern!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), own)


def copy_events(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The target's rows with the source's event columns where the keys agree."""
    return target.drop(*columns).join(source.select(*keys, *columns), keys, "left")


def matched_trials(first: DataFrame, second: DataFrame, least: float = 0.8) -> DataFrame:
    """Trials of both score tables (trial_id, event_code, score); ``few`` marks a match of less than ``least`` of the first.

    Trials whose event codes disagree stop the job: the tables are not of the same trials.
    """
    b = second.select("trial_id", F.col("event_code").alias("_code"), F.col("score").alias("score_2"))
    both = first.join(b, "trial_id")
    same = F.when(F.col("event_code") == F.col("_code"), F.col("event_code")).otherwise(F.raise_error(F.lit("the event codes of the trials don't match")).cast("int"))
    total = F.broadcast(first.agg(F.count(F.lit(1)).alias("_total")))  # one row
    counted = both.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return both.select("trial_id", same.alias("event_code"), F.col("score").alias("score_1"), "score_2").join(total, how="cross").join(F.broadcast(counted), how="cross").withColumn("few", F.col("_n") < F.col("_total") * least).drop("_n", "_total")


def artifact_trials(trials: DataFrame, artifacts: DataFrame, bucket: int) -> DataFrame:
    """Trials(subject, trial_id, start_ms, stop_ms) in which no artifact(subject, start_ms, stop_ms) begins or ends.

    An artifact counts when one of its ends lies strictly inside the trial; ends meet trials in buckets of time.
    """
    ends = artifacts.select("subject", F.explode(F.array("start_ms", "stop_ms")).alias("_at")).withColumn("bucket", F.expr(f"_at div {bucket}"))
    wide = trials.withColumn("bucket", F.explode(F.sequence(F.expr(f"start_ms div {bucket}"), F.expr(f"stop_ms div {bucket}"))))
    hit = wide.join(ends, ["subject", "bucket"]).where((F.col("_at") > F.col("start_ms")) & (F.col("_at") < F.col("stop_ms"))).select("subject", "trial_id").distinct()
    return trials.join(hit, ["subject", "trial_id"], "left_anti")


def continuous_events(events: DataFrame, recording: DataFrame, before: int, after: int) -> DataFrame:
    """(subject, event_id, time_ms, code): codes are null where the epoch around an event leaves its recording(subject, first_ms, last_ms)."""
    whole = (F.col("time_ms") + before >= F.col("first_ms")) & (F.col("time_ms") + after <= F.col("last_ms"))
    return events.join(recording, "subject").select("subject", "event_id", "time_ms", F.when(whole, F.col("code")).alias("code"))
