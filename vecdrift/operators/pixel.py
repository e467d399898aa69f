"""Histogram, texture and structure metrics of images given as long pixel tables or arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def density(pixels: DataFrame, group: str, value: str = "value", bins: int = BINS) -> DataFrame:
    """``group, bin, h``: share of pixels per integer value, dense over all bins (values outside are left out)."""
    spark = pixels.sparkSession
    c = pixels.where(F.col(value).between(0, bins - 1)).groupBy(group, F.col(value).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy(F.col(group).alias("g")).agg(F.sum("n").alias("t"))
    grid = total.crossJoin(F.broadcast(spark.range(bins).select(F.col("id").cast("int").alias("b"))))
    j = grid.join(c, (F.col("g") == F.col(group)) & (F.col("b") == F.col("bin")), "left")
    return j.select(F.col("g").alias(group), F.col("b").alias("bin"), (F.coalesce("n", F.lit(0)) / F.col("t")).alias("h"))


def sorted_density_distance(d: DataFrame, group: str, a, b) -> DataFrame:
    """One row ``wd``: mean absolute difference of the two densities' sorted values (bin places don't matter)."""
    w = Window.partitionBy(group).orderBy("h", "bin")
    r = d.where(F.col(group).isin(a, b)).withColumn("r", F.row_number().over(w))
    return r.groupBy("r").agg(F.abs(F.sum(F.when(F.col(group) == a, F.col("h")).otherwise(-F.col("h")))).alias("x")).agg(F.avg("x").alias("wd"))


def positional_distance(d: DataFrame, group: str, a, b) -> DataFrame:
    """One row ``wd_positional``: area between the cumulated densities, in bins."""
    x = d.where(F.col(group).isin(a, b)).groupBy("bin").agg(F.sum(F.when(F.col(group) == a, F.col("h")).otherwise(-F.col("h"))).alias("x"))
    return x.select(F.abs(F.sum("x").over(Window.orderBy("bin"))).alias("c")).agg(F.sum("c").alias("wd_positional"))


def kl(d: DataFrame, group: str, a, b, eps: float = 1e-10) -> DataFrame:
    """One row ``kl``: sum p ln(p/q) of the densities with eps added, normalised again."""
    x = d.where(F.col(group).isin(a, b)).groupBy("bin").agg(F.sum(F.when(F.col(group) == a, F.col("h"))).alias("p"), F.sum(F.when(F.col(group) == b, F.col("h"))).alias("q"))
    e = x.select((F.col("p") + eps).alias("p"), (F.col("q") + eps).alias("q"))
    t = e.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    return e.crossJoin(F.broadcast(t)).agg(F.sum(F.col("p") / F.col("sp") * F.log((F.col("p") / F.col("sp")) / (F.col("q") / F.col("sq")))).alias("kl"))


def histogram_intersection(pixels: DataFrame, group: str, a, b, channels: list[str]) -> DataFrame:
    """One row ``histi``: sum of minima of the joint channel histograms over the first one's sum (not symmetric)."""
    c = pixels.groupBy(*channels).agg(F.count(F.when(F.col(group) == a, 1)).alias("__na"), F.count(F.when(F.col(group) == b, 1)).alias("__nb"))
    return c.agg((F.sum(F.least("__na", "__nb")) / F.sum("__na").cast("double")).alias("histi"))


def glcm(pixels: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """keys, ``i, j, p`` of pixels ``keys, row, col, value``: normalised symmetric co-occurrence at a column offset."""
    right = pixels.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("row").alias("r_row"), (F.col("col") - distance).alias("r_col"), F.col("value").alias("j"))
    on = [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in keys]
    pairs = pixels.join(right, [*on, F.col("row") == F.col("r_row"), F.col("col") == F.col("r_col")]).select(*keys, F.col("value").alias("i"), "j")
    c = pairs.union(pairs.select(*keys, "j", "i")).groupBy(*keys, "i", "j").agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(*[F.col(k).alias(f"t_{k}") for k in keys]).agg(F.sum("n").alias("t"))
    return c.join(t, [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys]).select(*keys, "i", "j", (F.col("n") / F.col("t")).alias("p"))


TEXTURES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")


def texture(p: DataFrame, keys: list[str]) -> DataFrame:
    """keys and contrast, dissimilarity, homogeneity, energy, correlation of the co-occurrences."""
    i, j, w = F.col("i"), F.col("j"), F.col("p")
    d = i - j
    sums = {"contrast": w * d * d, "dissimilarity": w * F.abs(d), "homogeneity": w / (F.lit(1.0) + d * d), "energy": w * w, "mi": w * i, "mj": w * j, "ii": w * i * i, "jj": w * j * j, "ij": w * i * j}
    m = p.groupBy(*keys).agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    sd = F.sqrt(F.greatest((F.col("ii") - F.col("mi") * F.col("mi")) * (F.col("jj") - F.col("mj") * F.col("mj")), F.lit(0.0)))
    corr = F.when(sd < 1e-15, F.lit(1.0)).otherwise((F.col("ij") - F.col("mi") * F.col("mj")) / F.when(sd >= 1e-15, sd))
    return m.select(*keys, "contrast", "dissimilarity", "homogeneity", F.sqrt("energy").alias("energy"), corr.alias("correlation"))


def texture_similarity(pixels: DataFrame, keys: list[str], side: str, distances: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """keys, ``tsi``: of the two sides of each pair of images, summed absolute differences of five properties at each distance."""
    parts = None
    for d in distances:
        t = texture(glcm(pixels, [*keys, side], d), [*keys, side])
        gaps = [F.max(c) - F.min(c) for c in TEXTURES]  # two sides: the difference without its sign
        one = t.groupBy(*keys).agg(sum(gaps[1:], gaps[0]).alias("x"))
        parts = one if parts is None else parts.union(one)
    return parts.groupBy(*keys).agg(F.sum("x").alias("tsi"))


def ssim(x: np.ndarray, y: np.ndarray, window: int = 7, value_range: float = 255.0) -> float:
    """Mean structural similarity with a uniform window and sample covariances, by integral images."""

    def mean(a):
        s = np.pad(a.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return (s[window:, window:] - s[:-window, window:] - s[window:, :-window] + s[:-window, :-window]) / window**2

    unbiased = window**2 / (window**2 - 1)
    mx, my = mean(x), mean(y)
    vx, vy, vxy = (unbiased * (mean(p * q) - mp * mq) for p, q, mp, mq in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
    c1, c2 = (0.01 * value_range) ** 2, (0.03 * value_range) ** 2
    return float((((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx**2 + my**2 + c1) * (vx + vy + c2))).mean())


def ssim_pairs(pairs: DataFrame, height: int, width: int, window: int = 7, value_range: float = 255.0) -> DataFrame:
    """``id, ssim`` of ``id, a, b`` (flat arrays)."""

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "ssim": [ssim(np.reshape(a, (height, width)).astype(float), np.reshape(b, (height, width)).astype(float), window, value_range) for a, b in zip(pdf["a"], pdf["b"], strict=True)]})

    return pairs.select("id", "a", "b").mapInPandas(run, "id bigint, ssim double")


def to_uint8(x: Column) -> Column:
    """[0, 1] to 0..255, halves to even, clipped."""
    return F.bround(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
