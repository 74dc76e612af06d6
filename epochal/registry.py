"""The register of queries and of their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def final(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles rounded to six places."""
    whole, real = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}
    return df.select(*[F.col(c).cast("long").alias(c) if t in whole else (F.round(F.col(c).cast("double"), 6) + F.lit(0.0)).alias(c) if t in real else F.col(c) for c, t in df.dtypes])


def entry(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: final(f(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# pieces of the oracles' SQL --------------------------------------------------------------------------------

SAMPLES = "s AS (SELECT vec_id AS trial_id, label AS event_code, i AS t_idx, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, generate_series(1, 64) AS g(i))"
KEY = "(vec_id * 1103515245 + 12345) % 2147483648, vec_id"
MATRIX = "m AS (SELECT l_linenumber AS \"row\", p_size % 7 + 1 AS col, avg(l_discount) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
ANGLES = "a AS (SELECT o_orderpriority AS g, 2 * pi() * dayofyear(o_orderdate) / 366.0 AS alpha, o_totalprice AS x FROM orders), m AS (SELECT g, CAST(count(*) AS DOUBLE) AS n, sum(cos(alpha)) AS c, sum(sin(alpha)) AS s FROM a GROUP BY 1)"
HOURS = "h AS (SELECT user_id AS subject, hour(ts) + 1 AS sample, avg(value) AS value FROM events GROUP BY 1, 2)"


def rounded(expression: str, name: str) -> str:
    return f"ROUND({expression}, 6) + 0.0 AS {name}"


def normal_sql(x: str) -> str:
    """The normal distribution function, by its series."""
    return f"(0.5 + sign({x}) * exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * (SELECT sum(exp((2 * jj + 1) * ln(abs({x}) + 1e-300) - (lgamma(2.0 * jj + 2) - jj * ln(2.0) - lgamma(jj + 1.0)))) FROM generate_series(0, 300) AS series(jj)))"


# fixed values: Acklam's rational approximation of the normal quantile (relative error 1.15e-9), middle and tails
_MIDDLE = ([-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00], [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0])
_TAIL = ([-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00], [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0])


def normal_quantile_sql(p: str) -> str:
    """The normal quantile: a rational approximation and one Newton step."""
    horner = lambda c, x: "(" * len(c) + "0" + "".join(f" * {x} + ({v!r}))" for v in c)
    q, r = f"(({p}) - 0.5)", f"((({p}) - 0.5) * (({p}) - 0.5))"
    tail = lambda x: f"({horner(_TAIL[0], x)} / {horner(_TAIL[1], x)})"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - ({p})))"
    first = f"CASE WHEN ({p}) < 0.02425 THEN {tail(low)} WHEN ({p}) > 0.97575 THEN -{tail(high)} ELSE {horner(_MIDDLE[0], r)} * {q} / {horner(_MIDDLE[1], r)} END"
    return f"(SELECT z - ({normal_sql('z')} - p) * sqrt(2 * pi()) * exp(z * z / 2) FROM (SELECT {first} AS z, {p} AS p))"


def chi2_upper_sql(x: str, df: str) -> str:
    """1 - the chi squared distribution function, by its series."""
    return f"(1 - (SELECT sum(exp((({df}) / 2.0 + jj) * ln(({x}) / 2.0 + 1e-300) - ({x}) / 2.0 - lgamma(({df}) / 2.0 + jj + 1))) FROM generate_series(0, 2000) AS series(jj)))"


def beta_sql(x: str, a: str, b: str) -> str:
    """The regularised incomplete beta function for x not near 1, by its series."""
    term = f"exp(({a}) * ln({x} + 1e-300) + ({b}) * ln(1 - ({x})) + lgamma(({a}) + ({b}) + jj) - lgamma(({a}) + 1 + jj) - lgamma({b}) + jj * ln({x} + 1e-300))"
    return f"(SELECT sum({term}) FROM generate_series(0, 4000) AS series(jj))"


def t_two_sided_sql(t: str, df: str) -> str:
    return f"(1 - {beta_sql(f'(({t}) * ({t}) / (({df}) + ({t}) * ({t})))', '0.5', f'(({df}) / 2.0)')})"


def f_upper_sql(f: str, d1: str, d2: str) -> str:
    return f"(1 - {beta_sql(f'(({d1}) * ({f}) / (({d1}) * ({f}) + ({d2})))', f'(({d1}) / 2.0)', f'(({d2}) / 2.0)')})"
