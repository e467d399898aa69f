"""The frames behind tables and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def min_max(df: DataFrame, column: str, keys: list[str], eps: float = 1e-12) -> DataFrame:
    """Adds ``normalized``: (x - min) / (max - min + eps) per key group; the extremes join by key."""
    e = df.groupBy(*[F.col(k).alias(f"m_{k}") for k in keys]).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    j = df.join(F.broadcast(e), [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in keys]) if keys else df.crossJoin(F.broadcast(e))
    return j.withColumn("normalized", (F.col(column) - F.col("lo")) / (F.col("hi") - F.col("lo") + F.lit(eps))).drop("lo", "hi", *[f"m_{k}" for k in keys])


def trend(df: DataFrame, value: str, level: str, keys: list[str]) -> DataFrame:
    """keys, first, last, falling: whether the value at the last level is below that at the first."""
    g = df.groupBy(*keys).agg(F.min_by(value, level).alias("first"), F.max_by(value, level).alias("last"))
    return g.withColumn("falling", F.col("last") < F.col("first"))


def first_and_last(df: DataFrame, level: str, keys: list[str]) -> DataFrame:
    up, down = Window.partitionBy(*keys).orderBy(level), Window.partitionBy(*keys).orderBy(F.desc(level))
    return df.withColumns({"__a": F.row_number().over(up), "__b": F.row_number().over(down)}).where("__a = 1 OR __b = 1").drop("__a", "__b")


def axis_limits(points: DataFrame, x: str, y: str, pad: float = 0.04) -> DataFrame:
    """One row: shared limits with a margin of ``pad`` of each span."""
    g = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    px, py = (F.col("x1") - F.col("x0")) * pad, (F.col("y1") - F.col("y0")) * pad
    return g.select((F.col("x0") - px).alias("x_lo"), (F.col("x1") + px).alias("x_hi"), (F.col("y0") - py).alias("y_lo"), (F.col("y1") + py).alias("y_hi"))


def subsample(x: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement by seeded hash order (a top-k), sorted by id."""
    return x.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n).orderBy("id")


def fingerprint(x: DataFrame, samples: int = 256) -> DataFrame:
    """One row ``sha256`` over evenly strided rows of a set with ids 0..n-1 and its size; changes when the content does."""
    n = x.agg(F.count(F.lit(1)).alias("n"))
    stride = F.greatest(F.lit(1), F.floor(F.col("n") / samples))
    rows = x.crossJoin(F.broadcast(n)).where(F.col("id") % stride == 0)
    lines = rows.select("n", F.struct("id", F.to_json(F.struct("vec")).alias("v")).alias("r"))
    return lines.agg(F.sha2(F.concat_ws("\n", F.first("n").cast("string"), F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["v"]), "\n")), 256).alias("sha256"))


def job_grid(conditions: DataFrame, ids: DataFrame, done: DataFrame) -> DataFrame:
    """Condition x id jobs that aren't done; conditions are a small fixed dimension."""
    return ids.crossJoin(F.broadcast(conditions.select("degradation", "severity"))).join(done, ["degradation", "severity", "id"], "left_anti")


def cached_projection(sets: dict[str, DataFrame], path: str, project) -> tuple[dict[str, DataFrame], str]:
    """``project(sets)`` (frames ``id, x, y`` by name), kept as Parquet below ``path`` until the content of a set changes.

    The second value says what was found: "hit", "miss" (nothing kept) or "stale" (kept for other content).
    """
    spark = next(iter(sets.values())).sparkSession
    now = "|".join(f"{name}:{fingerprint(x).first()['sha256']}" for name, x in sorted(sets.items()))
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_fingerprint")
    there = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)
    names = {name: f"{path}/set={k}" for k, name in enumerate(sorted(sets))}
    if there and [r["value"] for r in spark.read.text(f"{path}/_fingerprint").collect()] == [now]:
        return {name: spark.read.parquet(at) for name, at in names.items()}, "hit"
    for name, frame in project(sets).items():
        frame.write.mode("overwrite").parquet(names[name])
    spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_fingerprint")
    return {name: spark.read.parquet(at) for name, at in names.items()}, "stale" if there else "miss"
