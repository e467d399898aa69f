"""Incremental forms of the additive operators, for sets that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_stream(pixels: DataFrame, keys: tuple[str, ...] = (), ignore: int = 255) -> DataFrame:
    """Running contingency counts (complete mode): state is one row per key, class pair."""
    return pixels.where(F.col("gt") != ignore).groupBy(*keys, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def condition_mean_stream(images: DataFrame, metrics: list[str]) -> DataFrame:
    """Running means by condition (complete mode)."""
    return images.groupBy("degradation", "severity").agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def windowed_mean(events: DataFrame, time: str, value: str, window: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Means by event-time window with a watermark, so state is bounded."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window).alias("w")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select("w.start", "w.end", "mean", "n")
