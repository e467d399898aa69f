"""Baseline-relative drops and the relational steps around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orientation(higher_better: Column) -> Column:
    """-1 where larger scores are better, so that a drop is a growing number."""
    return F.when(higher_better, F.lit(-1)).otherwise(F.lit(1))


def task_scores(perf: DataFrame, score: str, sign: int | None = None, keep_clean: bool = True) -> DataFrame:
    """degradation, severity, optional image_id, score (oriented if a sign is given)."""
    keys = [c for c in ("degradation", "severity", "image_id") if c in perf.columns]
    out = perf.select(*keys, (F.col(score) * F.lit(sign if sign is not None else 1)).alias("score"))
    return out if keep_clean else out.where("degradation <> 'clean'")


def condition_means(images: DataFrame, metrics: list[str]) -> DataFrame:
    return images.groupBy("degradation", "severity").agg(*[F.avg(m).alias(m) for m in metrics])


def condition_drop(scores: DataFrame, sign: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, degradation, severity, drop: sign (T_c - T_clean) / |T_clean|; the clean row joins by key (one row each)."""
    clean = scores.where("degradation = 'clean'").select(*[F.col(k).alias(f"c_{k}") for k in keys], F.col("score").alias("clean"))
    rest = scores.where("degradation <> 'clean'")
    j = rest.join(clean, [F.col(k) == F.col(f"c_{k}") for k in keys]) if keys else rest.crossJoin(F.broadcast(clean))
    return j.select(*keys, "degradation", "severity", (F.lit(sign) * (F.col("score") - F.col("clean")) / F.nullif(F.abs("clean"), F.lit(0.0))).alias("drop"))


def image_drop(scores: DataFrame, sign: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, degradation, severity, image_id, drop: sign (T_is - T_i,clean), not divided."""
    on = [*keys, "image_id"]
    clean = scores.where("degradation = 'clean'").select(*on, F.col("score").alias("clean"))
    return scores.where("degradation <> 'clean'").join(clean, on).select(*keys, "degradation", "severity", "image_id", (F.lit(sign) * (F.col("score") - F.col("clean"))).alias("drop"))


def in_config_order(df: DataFrame, conditions: DataFrame, datasets: list[str] | None = None) -> DataFrame:
    """Sorted by dataset place, condition ordinal, then the other key columns."""
    o = conditions.select("degradation", "severity", "ordinal")
    j = df.join(F.broadcast(o), ["degradation", "severity"], "left")
    first = [F.array_position(F.array(*[F.lit(d) for d in datasets]), F.col("dataset"))] if datasets else []
    rest = [c for c in ("space", "k", "image_id") if c in df.columns]
    return j.orderBy(*first, "ordinal", *rest).select(*df.columns)
