"""One door to all metrics by catalogue name, and the four distribution metrics of a condition against clean."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import METRICS
from ..functions import vectors as V
from . import moments as M
from . import pixel as P

#: Metrics of row-aligned feature vectors ``a`` and ``b``; which features they are is the caller's choice.
PAIRED: dict[str, Callable[[Column, Column], Column]] = {
    "Cos@Inc": V.cosine, "CLIP-sim": V.cosine, "Cos@VGG": V.cosine, "CPL": V.mse, "SSS": V.mse, "MSE": V.mse,
}
#: Metrics of two whole sets.
SETS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {}


def _frechet(clean: DataFrame, other: DataFrame) -> DataFrame:
    return clean.sparkSession.createDataFrame([(M.frechet(clean, other),)], "value double")


def _kernel(clean: DataFrame, other: DataFrame) -> DataFrame:
    return M.kid_subsets(clean, other).select(F.col("kid_mean").alias("value"))


SETS |= {"FID": _frechet, "FD@DINOv2": _frechet, "KID": _kernel, "KD@DINOv2": _kernel}


def paired(name: str, pairs: DataFrame) -> DataFrame:
    """``id, value`` of ``id, a, b``."""
    if name not in PAIRED:
        raise ValueError(f"unknown paired metric {name!r}")
    return pairs.select("id", PAIRED[name](F.col("a"), F.col("b")).alias("value"))


def between_sets(name: str, clean: DataFrame, other: DataFrame) -> DataFrame:
    """One row ``value``."""
    if name not in SETS:
        raise ValueError(f"unknown set metric {name!r}")
    return SETS[name](clean, other)


#: The image-level metrics in the order of their frame.
IMAGE_METRICS = tuple(name for name, level, _ in METRICS if level == "image")
#: Metrics of 8-bit grey images of one size, given as flat arrays.
PIXEL = ("SSIM", "TSI", "WD", "KL", "HistI")


def _shares(x: np.ndarray) -> np.ndarray:
    return np.bincount(x.reshape(-1), minlength=P.BINS)[: P.BINS] / x.size


def _co_occurrences(x: np.ndarray, distance: int) -> np.ndarray:
    i, j = x[:, :-distance].reshape(-1), x[:, distance:].reshape(-1)
    n = np.bincount(i * P.BINS + j, minlength=P.BINS**2).reshape(P.BINS, P.BINS).astype(float)
    return (n + n.T) / (n + n.T).sum()


def _texture(p: np.ndarray) -> np.ndarray:
    k = np.arange(P.BINS)
    d = k[:, None] - k[None, :]
    m = p.sum(axis=1) @ k
    v = p.sum(axis=1) @ (k - m) ** 2
    corr = 1.0 if v < 1e-15 else float((p * np.outer(k - m, k - m)).sum() / v)
    return np.array([(p * d * d).sum(), (p * np.abs(d)).sum(), (p / (1.0 + d * d)).sum(), np.sqrt((p * p).sum()), corr])


def pixel_value(name: str, a: np.ndarray, b: np.ndarray) -> float:
    """A metric of ``PIXEL`` of two 8-bit grey images [height, width]."""
    if name == "SSIM":
        return P.ssim(a.astype(float), b.astype(float))
    if name == "TSI":
        return float(sum(np.abs(_texture(_co_occurrences(a, d)) - _texture(_co_occurrences(b, d))).sum() for d in (1, 2, 3)))
    p, q = _shares(a), _shares(b)
    if name == "WD":
        return float(np.abs(np.sort(p) - np.sort(q)).mean())
    if name == "KL":
        p, q = (x + 1e-10 for x in (p, q))
        p, q = p / p.sum(), q / q.sum()
        return float((p * np.log(p / q)).sum())
    if name == "HistI":
        return float(np.minimum(p, q).sum() / p.sum())
    raise ValueError(f"unknown pixel metric {name!r}")


def pixel_metrics(pairs: DataFrame, height: int, width: int, names: tuple[str, ...] = PIXEL) -> DataFrame:
    """``id`` and a column a metric of ``id, a, b`` (flat arrays of 0..255); one pass, a pair at a time."""
    def run(frames):
        for pdf in frames:
            out = {"id": pdf["id"]}
            images = [tuple(np.asarray(x, np.int64).reshape(height, width) for x in ab) for ab in zip(pdf["a"], pdf["b"], strict=True)]
            for n in names:
                out[n] = [pixel_value(n, a, b) for a, b in images]
            yield pd.DataFrame(out)

    return pairs.select("id", "a", "b").mapInPandas(run, "id bigint, " + ", ".join(f"`{n}` double" for n in names))


def lpips(pairs: DataFrame, weights: list[float]) -> DataFrame:
    """``id, value`` of ``id, a, b``: weighted squared differences of unit feature vectors."""
    return pairs.select("id", V.weighted_channel_difference(F.col("a"), F.col("b"), weights).alias("value"))


def metric(name: str, pairs: DataFrame, **options) -> DataFrame:
    """``id, value`` of any image-level metric by name: features for the paired ones, pixels with height and width for the others."""
    if name == "LPIPS":
        return lpips(pairs, options["weights"])
    if name in PIXEL:
        return pixel_metrics(pairs, options["height"], options["width"], (name,)).withColumnRenamed(name, "value")
    return paired(name, pairs)


def image_metrics(conditions: dict[tuple[str, int], dict[str, DataFrame]], height: int, width: int, weights: list[float]) -> DataFrame:
    """``degradation, severity, image_id`` and the twelve image metrics of every condition but clean.

    ``conditions`` gives frames ``id, a, b`` (clean, degraded) by metric name, and ``pixels`` for those of 8-bit images.
    """
    out = None
    for (degradation, severity), frames in sorted(conditions.items()):
        if degradation == "clean":
            continue
        one = pixel_metrics(frames["pixels"], height, width)
        for name in IMAGE_METRICS:
            if name not in PIXEL:
                one = one.join(metric(name, frames[name], weights=weights).select("id", F.col("value").alias(name)), "id")
        one = one.select(F.lit(degradation).alias("degradation"), F.lit(severity).alias("severity"), F.col("id").alias("image_id"), *[F.col(f"`{n}`") for n in IMAGE_METRICS])
        out = one if out is None else out.unionByName(one)
    return out


def set_metrics(spaces: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """``metric, value`` of the four distribution metrics; ``spaces`` gives (clean, other) for "inception" and "dino"."""
    wanted = (("FID", "inception"), ("KID", "inception"), ("FD@DINOv2", "dino"), ("KD@DINOv2", "dino"))
    out = None
    for name, space in wanted:
        one = between_sets(name, *spaces[space]).select(F.lit(name).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out
