"""Task scores on long pixel tables: segmentation entropy, depth errors, label maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remap(label: Column, mapping: dict[int, int], other: int = 255) -> Column:
    """Labels through a map, what isn't in it to ``other``; the map is a literal in the plan."""
    pairs = [F.lit(x) for kv in sorted(mapping.items()) for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(other))


def softmax_entropy(scores: Column) -> Column:
    """-sum p ln(p + 1e-12) of softmax scores in an array; NaN for none."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    h = F.aggregate(e, F.lit(0.0), lambda s, x: s - x / total * F.log(x / total + F.lit(1e-12)))
    return F.when(F.size(scores) > 0, h).otherwise(F.lit(float("nan")))


def depth_metrics(pixels: DataFrame, keys: tuple[str, ...] = (), gt: str = "gt", pred: str = "pred") -> DataFrame:
    """The eight depth errors per group of positive ``gt, pred``, one aggregation."""
    g, p = F.col(gt), F.col(pred)
    e, r = F.log(p) - F.log(g), F.greatest(g / p, p / g)
    return pixels.groupBy(*keys).agg(
        F.avg(F.abs(g - p) / g).alias("abs_rel"), F.avg((g - p) * (g - p) / g).alias("sq_rel"), F.sqrt(F.avg((g - p) * (g - p))).alias("rmse"), F.sqrt(F.avg(e * e)).alias("rmse_log"),
        *[F.avg((r < 1.25**i).cast("double")).alias(f"a{i}") for i in (1, 2, 3)], ((F.avg(e * e) - F.avg(e) * F.avg(e)) * 100).alias("silog"),
    )


#: Fractions of height and width that the crop keeps (top, bottom, left, right).
CROP = (0.40810811, 0.99189189, 0.03594771, 0.96405229)


def valid(pixels: DataFrame, low: float = 1e-3, high: float = 80.0, height: int | None = None, width: int | None = None) -> DataFrame:
    """Pixels with a depth strictly inside the range and, for known sizes, inside the crop (bounds truncated)."""
    out = pixels.where((F.col("gt") > low) & (F.col("gt") < high))
    if height and width:
        t, b, left, r = int(CROP[0] * height), int(CROP[1] * height), int(CROP[2] * width), int(CROP[3] * width)
        out = out.where((F.col("row") >= t) & (F.col("row") < b) & (F.col("col") >= left) & (F.col("col") < r))
    return out


def median_scaled(pixels: DataFrame, keys: tuple[str, ...], low: float = 1e-3, high: float = 80.0) -> DataFrame:
    """``pred`` times the group's median(gt)/median(pred), exact medians, clipped to the range."""
    m = pixels.groupBy(*[F.col(k).alias(f"m_{k}") for k in keys]).agg((F.percentile("gt", F.lit(0.5)) / F.percentile("pred", F.lit(0.5))).alias("ratio"))
    on = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]
    j = pixels.join(m, on) if keys else pixels.crossJoin(m)
    return j.withColumn("pred", F.least(F.greatest(F.col("pred") * F.col("ratio"), F.lit(low)), F.lit(high))).drop("ratio", *[f"m_{k}" for k in keys])


def sigmoid_to_depth(d: Column, low: float = 0.1, high: float = 100.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0 / high) + F.lit(1.0 / low - 1.0 / high) * d)


def nearest_resize(pixels: DataFrame, shape: tuple[int, int], target: tuple[int, int], keys: tuple[str, ...] = ("image_id",)) -> DataFrame:
    """keys, row, col, value of label maps resized by nearest neighbour: target place i reads place floor(i * size / target).

    Each source pixel is exploded to the target places that read it, so nothing is joined or shuffled.
    """

    def readers(at: Column, size: int, new: int) -> Column:
        first = F.ceil(at * F.lit(new) / F.lit(size)).cast("int")
        last = (F.ceil((at + 1) * F.lit(new) / F.lit(size)) - 1).cast("int")
        return F.when(first <= last, F.sequence(first, last))

    rows = pixels.select(*keys, F.explode(readers(F.col("row"), shape[0], target[0])).alias("row"), F.col("col").alias("c"), "value")
    return rows.select(*keys, "row", F.explode(readers(F.col("c"), shape[1], target[1])).alias("col"), "value")
