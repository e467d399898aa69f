"""Rank correlation by group, Fisher-z means, summaries, redundancy and sensitivity."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(column: str, keys: list[str]) -> Column:
    """Rank with ties at their mean."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(column)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, column)) - 1) / 2.0


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """keys, n, rho over rows where both are present; groups with a constant side are left out.

    Groups are conditions, images of one type and the like: rank windows need a group in a task (they spill), and that
    is their bound.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    r = rows.select(*keys, average_rank(x, keys).alias("rx"), average_rank(y, keys).alias("ry"))
    n, sx, sy = F.count(F.lit(1)), F.stddev_pop("rx"), F.stddev_pop("ry")
    g = r.groupBy(*keys).agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), F.covar_pop("rx", "ry").alias("c"))
    return g.where("sx > 0 AND sy > 0").select(*keys, "n", (F.col("c") / (F.col("sx") * F.col("sy"))).alias("rho"))


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long form: keys, metric, value."""
    return df.unpivot(keys, metrics, "metric", "value")


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h / a


def p_value(rho: float, n: int) -> float:
    """Two-sided, t-approximation with n - 2 degrees of freedom."""
    if n < 3 or math.isnan(rho):
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    t2 = rho * rho * df / (1 - rho * rho)
    return _betainc(df / 2, 0.5, df / (df + t2))


def with_p(rhos: DataFrame) -> DataFrame:
    """Adds ``p`` to frames with ``rho, n`` (one row a group)."""

    @F.pandas_udf("double")
    def p(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([p_value(float(r), int(m)) for r, m in zip(rho, n, strict=True)])

    # pandas hands NaN over as null
    return rhos.withColumn("p", F.coalesce(p("rho", "n"), F.lit(float("nan"))))


def fisher_mean(rho: str) -> Column:
    """tanh of the mean of atanh of correlations clipped to 0.999999; NaN and null are skipped."""
    c = F.when(~F.isnan(rho), F.least(F.greatest(F.col(rho), F.lit(-0.999999)), F.lit(0.999999)))
    return F.tanh(F.avg(F.atanh(c)))


def summary(rhos: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_types, rho (Fisher mean), z_sd (sample), n_pos, rho_min, rho_max."""
    z = F.atanh(F.least(F.greatest("rho", F.lit(-0.999999)), F.lit(0.999999)))
    return rhos.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_types"), fisher_mean("rho").alias("rho"), F.stddev_samp(z).alias("z_sd"), F.count_if(F.col("rho") > 0).alias("n_pos"), F.min("rho").alias("rho_min"), F.max("rho").alias("rho_max"))


def require_complete(grid: DataFrame, keys: list[str], expected: int) -> None:
    """ValueError if a group lacks rows or has a missing drop."""
    bad = grid.groupBy(*keys).agg(F.count(F.when(~F.isnan("drop"), F.col("drop"))).alias("n")).where(F.col("n") != expected).limit(5).collect()
    if bad:
        raise ValueError(f"incomplete: {[tuple(r) for r in bad]}")


def redundancy(fact: DataFrame) -> DataFrame:
    """``metric, space_a, space_b, n, rho`` over levels of ``space, level, metric, value``; at least 3 levels."""
    b = fact.select(F.col("space").alias("space_b"), F.col("level").alias("lb"), F.col("metric").alias("mb"), F.col("value").alias("vb"))
    j = fact.withColumnRenamed("space", "space_a").join(b, (F.col("level") == F.col("lb")) & (F.col("metric") == F.col("mb")) & (F.col("space_a") < F.col("space_b")))
    return spearman(j, "value", "vb", ["metric", "space_a", "space_b"]).where("n >= 3")


def k_sensitivity(fact: DataFrame) -> DataFrame:
    """``space, metric, cv``: mean over levels of population deviation over |mean| across k (1 where |mean| < 1e-10)."""
    m = F.abs(F.avg("value"))
    per = fact.groupBy("space", "metric", "level").agg((F.stddev_pop("value") / F.when(m < 1e-10, F.lit(1.0)).otherwise(m)).alias("cv"))
    return per.groupBy("space", "metric").agg(F.avg("cv").alias("cv"))
