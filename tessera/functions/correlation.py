"""Correlation of paired values: Pearson, Spearman on pair-complete ranks, and p-values."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.operators.relops import rank_avg_ties


def pearson(x: Column, y: Column) -> Column:
    """An aggregate; null below two pairs and without variance (where the built-in function raises)."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).cast("double")
    sx, sy, sxx, syy, sxy = F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    ok = (n >= 2) & (vx > 1e-12 * n * sxx) & (vy > 1e-12 * n * syy)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (n * sxy - sx * sy) / F.sqrt(F.when(ok, vx * vy).otherwise(1.0)))))


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by Lentz's method."""
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def student_p(r: float | None, n: float | None) -> float | None:
    """Two-sided p-value of a correlation of n pairs; None below 3 pairs or for |r| of 1."""
    if r is None or n is None or math.isnan(r) or n < 3 or abs(r) >= 1:
        return None
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return incomplete_beta(df / 2, 0.5, df / (df + t2))


@F.pandas_udf(DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([student_p(a, b) for a, b in zip(r, n, strict=True)], dtype=float)


def pair_correlations(values: DataFrame, item: str, via: str, value: str, floor: int = 3, spearman: bool = True) -> DataFrame:
    """(a, b, n, r, t): for items a <= b their correlation over the values of ``via`` that both have.

    Ranks are taken within each pair's complete rows.  Pairs with fewer than ``floor`` have a null r;
    t is the statistic whose p-value p_value(r, n) gives.
    """
    d = values.select(item, via, F.col(value).cast("double").alias("v")).dropna()
    a, b = d.select(F.col(item).alias("a"), via, F.col("v").alias("x")), d.select(F.col(item).alias("b"), via, F.col("v").alias("y"))
    pairs = a.join(b, via).filter("a <= b")
    if spearman:
        pairs = pairs.withColumns({"rx": rank_avg_ties(F.col("x"), ["a", "b"]), "ry": rank_avg_ties(F.col("y"), ["a", "b"])})
    else:
        pairs = pairs.withColumns({"rx": F.col("x"), "ry": F.col("y")})
    got = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("rx"), F.col("ry")).alias("r0"))
    r = F.when(F.col("a") == F.col("b"), F.lit(1.0)).when(F.col("n") >= floor, F.col("r0"))
    got = got.withColumn("r", r)
    inside = F.abs("r") < 1
    return got.select("a", "b", "n", "r", F.when(inside & (F.col("n") >= 3), F.col("r") * F.sqrt((F.col("n") - 2) / F.when(inside, 1 - F.col("r") * F.col("r")).otherwise(1.0))).alias("t"))


