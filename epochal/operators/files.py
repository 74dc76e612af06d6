"""Lists of result files: pairs, training and test, what is missing, arguments of jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zipped(a: DataFrame, b: DataFrame, name: str = "name") -> DataFrame:
    """``a;b`` of two sorted lists of equal length, place by place; unequal lengths stop the job.

    Lists name files, so a list is small enough for one ordering.
    """
    place = lambda df: df.select(F.col(name), F.row_number().over(Window.orderBy(name)).alias("_k"))
    both = place(a).join(place(b).withColumnRenamed(name, "_other"), "_k", "full")
    pair = F.when(F.col(name).isNotNull() & F.col("_other").isNotNull(), F.concat_ws(";", name, "_other")).otherwise(F.raise_error(F.lit("the lists are of unequal length")).cast("string"))
    return both.select(pair.alias("pair"))


def zipped_by_pattern(a: DataFrame, b: DataFrame, patterns: DataFrame, name: str = "name", place: str = "place") -> DataFrame:
    """(pattern, pair): for every pattern(pattern) the last name of either list that contains it; lists have name and place."""
    own = F.broadcast(patterns.select("pattern"))  # a stated list
    last = lambda df, c: df.join(own, F.col(name).contains(F.col("pattern"))).groupBy("pattern").agg(F.max_by(name, place).alias(c))
    return patterns.select("pattern").join(last(a, "_a"), "pattern", "left").join(last(b, "_b"), "pattern", "left").select("pattern", F.concat(F.coalesce("_a", F.lit("")), F.lit(";"), F.coalesce("_b", F.lit(""))).alias("pair"))


def train_test_pairs(names: DataFrame, name: str = "name") -> DataFrame:
    """(train, test): every ordered pair of different subjects of a list."""
    other = F.broadcast(names.select(F.col(name).alias("test")))  # a list of subjects
    return names.select(F.col(name).alias("train")).join(other, F.col("train") != F.col("test"))


def missing(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted results that are not there."""
    return wanted.join(present.select(*keys).distinct(), keys, "left_anti")


def job_arguments(lists: list[DataFrame], together: bool = False) -> DataFrame:
    """A row of arguments for each job: all combinations of the lists' rows, or, ``together``, their rows place by place.

    Lists for the second form have a column ``place``; the shortest one ends it.
    """
    if together:
        return reduce(lambda a, b: a.join(b, "place"), lists)
    return reduce(lambda a, b: a.join(F.broadcast(b), how="cross"), lists)  # stated lists of settings


def delimited(table: DataFrame, delimiter: str = ",") -> DataFrame:
    """Rows as text for a text sink; null cells are empty."""
    return table.select(F.concat_ws(delimiter, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in table.columns]).alias("value"))


def in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both lists have."""
    return a.intersect(b)


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of the first list that the second has not."""
    return a.subtract(b)
