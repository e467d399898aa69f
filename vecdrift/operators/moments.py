"""Set-level statistics: means, dispersion, covariance, effective rank, Frechet and kernel distances.

Second moments are one pass: per-partition X'X blocks in numpy (``mapInPandas``), summed by Spark; only D x D reaches
the driver, never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V


def column_mean(x: DataFrame) -> DataFrame:
    """``(pos, mean)`` of every axis."""
    return x.select(F.posexplode("vec").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"))


def dispersion(x: DataFrame) -> DataFrame:
    """One row: root of the mean over axes of the population variance."""
    return x.select(F.posexplode("vec").alias("pos", "v")).groupBy("pos").agg(F.var_pop("v").alias("s")).agg(F.sqrt(F.avg("s")).alias("sigma"))


def covariance(x: DataFrame, sample: bool = True, dims: int | None = None) -> DataFrame:
    """``(i, j, cov)`` for i <= j, declaratively: axis pairs within a row, then one aggregation."""
    vec = F.slice("vec", 1, dims) if dims else F.col("vec")
    a = x.select(vec.alias("v")).select("v", F.posexplode("v").alias("i", "xi"))
    pairs = a.select("i", "xi", F.posexplode("v").alias("j", "xj")).where("i <= j")
    return pairs.groupBy("i", "j").agg((F.covar_samp if sample else F.covar_pop)("xi", "xj").alias("cov"))


def moments(x: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, scatter about the mean) with only D x D numbers collected. Partials are shifted by a common row."""
    first = x.select("vec").limit(1).toPandas()
    if not len(first):
        raise ValueError("empty set")
    shift = np.array(first["vec"][0], np.float64)
    d = len(shift)

    def partial(frames):
        n, s, g = 0, np.zeros(d), np.zeros((d, d))
        for pdf in frames:
            m = np.array(pdf["vec"].tolist(), np.float64).reshape(-1, d) - shift
            n, s, g = n + len(m), s + m.sum(axis=0), g + m.T @ m
        values = np.concatenate(([n], s, g.reshape(-1)))
        yield pd.DataFrame({"pos": np.arange(len(values)), "v": values})

    total = x.select("vec").mapInPandas(partial, "pos int, v double").groupBy("pos").agg(F.sum("v").alias("v")).orderBy("pos").toPandas()["v"].to_numpy()
    n, s, g = int(total[0]), total[1 : d + 1], total[d + 1 :].reshape(d, d)
    return n, shift + s / n, g - np.outer(s, s) / n


def rank_of_spectrum(values: np.ndarray) -> float:
    """exp of the entropy of the normalised spectrum."""
    values = np.maximum(values, 0)
    p = values / max(values.sum(), 1e-30)
    p = p[p > 1e-12]
    return float(np.exp(-(p * np.log(p)).sum()))


def effective_rank(x: DataFrame) -> float:
    n, _, scatter = moments(x)
    try:
        return rank_of_spectrum(np.linalg.eigvalsh(scatter / max(n - 1, 1)))
    except np.linalg.LinAlgError:
        return float("nan")


def set_stats(x: DataFrame) -> DataFrame:
    """One row: mu (array), sigma, effective_rank."""
    n, mu, scatter = moments(x)
    sigma = float(np.sqrt(np.trace(scatter) / (n * len(mu))))
    rank = rank_of_spectrum(np.linalg.eigvalsh(scatter / max(n - 1, 1)))
    return x.sparkSession.createDataFrame([(mu.tolist(), sigma, rank)], "mu array<double>, sigma double, effective_rank double")


def position_shift(real: DataFrame, gen: DataFrame) -> DataFrame:
    """One row: distance of the means in units of the real set's dispersion, per set and per axis root."""
    r = real.select(F.posexplode("vec").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mr"), F.var_pop("v").alias("vr"))
    g = column_mean(gen).withColumnRenamed("pos", "gp")
    j = r.join(g, F.col("pos") == F.col("gp"))
    out = j.agg(F.sqrt(F.sum(F.pow(F.col("mr") - F.col("mean"), F.lit(2)))).alias("shift"), F.sqrt(F.avg("vr")).alias("sigma"), F.count(F.lit(1)).alias("d"))
    ratio = F.when(F.col("sigma") > 0, F.col("shift") / F.when(F.col("sigma") > 0, F.col("sigma")))
    return out.select("shift", "sigma", ratio.alias("shift_over_sigma"), (ratio / F.sqrt("d")).alias("shift_over_sigma_root_d"))


def frechet(a: DataFrame, b: DataFrame, ridge: float = 1e-6) -> float:
    """Squared mean distance plus trace of C1 + C2 - 2 (C1 C2)^(1/2), sample covariances with a ridge."""
    n1, m1, s1 = moments(a)
    n2, m2, s2 = moments(b)
    eye = ridge * np.eye(len(m1))
    c1, c2 = s1 / (n1 - 1) + eye, s2 / (n2 - 1) + eye
    w, v = np.linalg.eigh(c1)
    root = (v * np.sqrt(np.maximum(w, 0))) @ v.T
    cross = np.sqrt(np.maximum(np.linalg.eigvalsh(root @ c2 @ root), 0)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * cross)


def _kernel_sum(rows: DataFrame, base: np.ndarray, same: bool) -> DataFrame:
    """One row ``s``: the kernel (x.y / D + 1)^3 summed over all pairs of a row and a base row, without a row's own."""
    shared = rows.sparkSession.sparkContext.broadcast(base)

    def run(frames):
        m = shared.value
        d = m.shape[1]
        total = 0.0
        for pdf in frames:
            x = np.array(pdf["vec"].tolist(), np.float64).reshape(-1, d)
            for at in range(0, len(x), 512):
                few = x[at : at + 512]
                total += float((((few @ m.T) / d + 1) ** 3).sum())
                if same:
                    total -= float((((few * few).sum(axis=1) / d + 1) ** 3).sum())
        yield pd.DataFrame({"s": [total]})

    return rows.select("vec").mapInPandas(run, "s double").agg(F.sum("s").alias("s"))


def kid(a: DataFrame, b: DataFrame, dim: int) -> DataFrame:
    """One row: the unbiased squared maximum mean discrepancy of the whole sets, kernel (x.y / D + 1)^3.

    While each set's checked size allows, it is broadcast and pairs are matrix products whose sums alone leave a task;
    larger sets are stated as pair sums in SQL, both sides distributed.
    """
    from .knn import BROADCAST_BYTES

    n, m = a.count(), b.count()
    if min(n, m) < 2:
        raise ValueError("two rows a set are needed")
    if max(n, m) * dim * 8 > BROADCAST_BYTES:
        return _kid_sql(a, b, dim)
    spread = a.sparkSession.sparkContext.defaultParallelism
    left, right = (np.array(x.select("vec").toPandas()["vec"].tolist(), np.float64) for x in (a, b))
    a, b = a.repartition(spread), b.repartition(spread)
    xx, yy, xy = _kernel_sum(a, left, True), _kernel_sum(b, right, True), _kernel_sum(a, right, False)
    j = xx.toDF("xx").crossJoin(yy.toDF("yy")).crossJoin(xy.toDF("xy"))
    return j.select((F.col("xx") / (n * (n - 1)) + F.col("yy") / (m * (m - 1)) - F.lit(2.0) * F.col("xy") / (n * m)).alias("kid"))


def _kid_sql(a: DataFrame, b: DataFrame, dim: int) -> DataFrame:
    x = a.select(F.col("id").alias("i"), F.col("vec").alias("v"))
    y = b.select(F.col("id").alias("j"), F.col("vec").alias("w"))
    spread = a.sparkSession.sparkContext.defaultParallelism
    kernel = F.pow(V.dot(F.col("v"), F.col("w"), dim) / F.lit(float(dim)) + F.lit(1.0), F.lit(3.0))

    def within(s):
        pairs = s.toDF("i", "v").repartition(spread).crossJoin(s.toDF("j", "w")).where("i <> j")
        return pairs.agg((F.sum(kernel) / F.count(F.lit(1))).alias("k"))

    cross = x.repartition(spread).crossJoin(y).agg(F.avg(kernel).alias("xy"))
    parts = within(x).withColumnRenamed("k", "xx").crossJoin(within(y).withColumnRenamed("k", "yy")).crossJoin(cross)
    return parts.select((F.col("xx") + F.col("yy") - F.lit(2.0) * F.col("xy")).alias("kid"))


def kid_subsets(a: DataFrame, b: DataFrame, subsets: int = 50, size: int = 1000, seed: int = 0) -> DataFrame:
    """One row: mean and population deviation over seeded subsets (hash order of id and subset number).

    A subset's rows are chosen by Spark (top of a hash order) and evaluated in one task each; ``size`` bounds them.
    """
    spark = a.sparkSession
    n = min(size, a.count(), b.count())
    numbers = spark.range(subsets).withColumnRenamed("id", "subset")

    def chosen(df, side):
        from pyspark.sql import Window

        rows = df.select("id", "vec").crossJoin(F.broadcast(numbers)).withColumn("o", F.xxhash64(F.lit(seed), F.lit(side), "subset", "id"))
        w = Window.partitionBy("subset").orderBy("o", "id")
        return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("subset", F.lit(side).alias("side"), "vec")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.array(pdf.loc[pdf["side"] == s, "vec"].tolist(), np.float64) for s in (0, 1))
        k = lambda p, q: (p @ q.T / p.shape[1] + 1) ** 3
        kx, ky, m = k(x, x), k(y, y), len(x)
        v = (kx.sum() - np.trace(kx)) / (m * (m - 1)) + (ky.sum() - np.trace(ky)) / (m * (m - 1)) - 2 * k(x, y).mean()
        return pd.DataFrame({"subset": [pdf["subset"].iloc[0]], "v": [v]})

    each = chosen(a, 0).union(chosen(b, 1)).groupBy("subset").applyInPandas(one, "subset bigint, v double")
    return each.agg(F.avg("v").alias("kid_mean"), F.stddev_pop("v").alias("kid_std"))
