"""Local intrinsic dimension from k-NN frames whose ``distance`` is a true distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NAN = float("nan")


def lid(neighbors: DataFrame, k: int) -> DataFrame:
    """``(query_id, lid)``: -(k - 2) / sum over the first k - 1 of ln(d / d_k); 0 where degenerate. Columns past k are unread."""
    near = neighbors.where(F.col("rank") <= k)
    last = F.max(F.when(F.col("rank") == k, F.col("distance")))
    logs = F.sum(F.when(F.col("rank") < k, F.log(F.greatest("distance", F.lit(1e-10)))))
    g = near.groupBy("query_id").agg(last.alias("dk"), logs.alias("logs"))
    total = F.col("logs") - F.lit(float(k - 1)) * F.log(F.greatest("dk", F.lit(1e-10)))
    safe = F.when(total < -1e-6, total)
    value = F.when((F.col("dk") < 1e-10) | safe.isNull() | F.lit(k <= 2), F.lit(0.0)).otherwise(F.lit(-float(k - 2)) / safe)
    return g.select("query_id", value.alias("lid"))


def twonn(neighbors: DataFrame, least: int = 10, kept: float = 0.9) -> DataFrame:
    """One row ``(twonn, m)``: slope through the origin of -ln(1 - j/m) against ln(d2/d1), lowest 90 % of ratios.

    Ratios are ranked globally; that ranking is an order of one number a point. NaN below ``least`` usable points.
    """
    d1 = F.max(F.when(F.col("rank") == 1, F.col("distance")))
    d2 = F.max(F.when(F.col("rank") == 2, F.col("distance")))
    pairs = neighbors.where("rank <= 2").groupBy("query_id").agg(d1.alias("d1"), d2.alias("d2")).where("d1 > 1e-12 AND d2 IS NOT NULL")
    ratios = pairs.select(F.expr("d2 / d1").alias("r")).where("r > 1 AND r < double('Infinity')")
    ranked = _global_rank(ratios, "r")
    keep = F.floor(F.lit(kept) * F.col("m"))
    x, y = F.log("r"), -F.log(F.lit(1.0) - F.when(F.col("j") <= keep, F.col("j")) / F.col("m"))
    sums = ranked.where(F.col("j") <= keep).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.max("m").alias("m"))
    value = F.when((F.coalesce("m", F.lit(0)) < least) | (F.coalesce("xx", F.lit(0.0)) == 0), F.lit(NAN)).otherwise(F.col("xy") / F.when(F.col("xx") > 0, F.col("xx")))
    return sums.select(value.alias("twonn"), F.coalesce("m", F.lit(0)).cast("bigint").alias("m"))


def _global_rank(df: DataFrame, column: str) -> DataFrame:
    """Adds j (place in ascending order, from 1) and m (rows) without one task holding all rows: range partitions are
    ranked on their own and shifted by the counts before them."""
    from ..sources.store import materialize

    parts = df.repartitionByRange(column).sortWithinPartitions(column).withColumn("p", F.spark_partition_id())
    parts = materialize(parts, "ranked")
    counts = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("p").alias("q"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("s"), F.sum("n").over(Window.partitionBy()).alias("m"))
    own = F.row_number().over(Window.partitionBy("p").orderBy(column))
    return parts.withColumn("o", own).join(F.broadcast(shift), F.col("p") == F.col("q")).select(column, (F.col("o") + F.col("s")).alias("j"), "m")


def lid_profile(neighbors: DataFrame, k: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Per-point LID and global TwoNN from one search; NaN per point if k < 3 or k > n - 1."""
    points = lid(neighbors, k) if 3 <= k <= n - 1 else neighbors.select("query_id").distinct().withColumn("lid", F.lit(NAN))
    return points, twonn(neighbors)
