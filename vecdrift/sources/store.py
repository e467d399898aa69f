"""Tables in shared storage: materialised intermediates, partition-replacing upserts, resume scans, JSON results."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset a temporary one of our own, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = tempfile.mkdtemp(prefix="vecdrift-")
    return "file://" + shared_dir.own


def delete_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_delete, weakref.ref(spark), path)


def delete_now(spark: SparkSession, path: str) -> None:
    _delete(weakref.ref(spark), path)


def _delete(spark_ref, path: str) -> None:
    spark = spark_ref()
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
    except Exception:  # the session has ended; nothing is left to delete it with
        pass


def materialize(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as a scan of those files (kept until Python exits).

    Cuts the lineage at a table every executor can reach: a lost executor costs a re-read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vecdrift/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def replace_partition(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``existing`` whose keys ``new`` doesn't bring, and the rows of ``new`` (missing columns are null)."""
    brought = new.select(*keys).distinct()
    on = [existing[k].eqNullSafe(brought[k]) for k in keys]
    return existing.join(brought, on, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_parquet(new: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions that ``new`` brings of a Parquet table partitioned by ``keys``; others stay untouched."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def remaining(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What is wanted and not yet done (resume scan)."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def incomplete(wanted: DataFrame, have: DataFrame, keys: list[str], item: str) -> DataFrame:
    """Groups with fewer distinct items than wanted: keys, wanted, have."""
    w = wanted.groupBy(*keys).agg(F.countDistinct(item).alias("wanted"))
    h = have.groupBy(*keys).agg(F.countDistinct(item).alias("have"))
    return w.join(h, keys, "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < wanted")


def available_in_all(files: DataFrame, group: str, tag: str, required: list[str]) -> DataFrame:
    """Relational division: groups that have every required tag."""
    return files.where(F.col(tag).isin(required)).groupBy(group).agg(F.countDistinct(tag).alias("n")).where(F.col("n") == len(set(required))).select(group)


def ranges(tags: DataFrame, order: str, tag: str, count: str) -> DataFrame:
    """Half-open row ranges of folders pooled in order; a tag that comes again gets ``#1``, ``#2``, ..."""
    from pyspark.sql import Window

    before = F.coalesce(F.sum(count).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint")
    again = F.row_number().over(Window.partitionBy(tag).orderBy(order))
    name = F.when(again == 1, F.col(tag)).otherwise(F.concat_ws("#", F.col(tag), (again - 1).cast("string")))
    return tags.select(name.alias("tag"), before.alias("start"), (before + F.col(count)).cast("bigint").alias("end"), F.col(count).cast("bigint").alias("count"))


def nested_results(fact: DataFrame) -> DataFrame:
    """One row ``json``: space -> k -> level -> metric -> value of a long fact table."""
    def nest(df, keys, value):
        entry = F.struct(F.col(keys[-1]).cast("string").alias("key"), value.alias("value"))
        by_key = F.expr("array_sort(__e, (a, b) -> CASE WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END)")
        return df.groupBy(*keys[:-1]).agg(F.collect_list(entry).alias("__e")).withColumn("m", F.map_from_entries(by_key)).drop("__e")

    out, keys, value = fact, ["space", "k", "level", "metric"], F.col("value")
    while keys:
        out = nest(out, keys, value)
        keys, value = keys[:-1], F.col("m")
    return out.select(F.to_json("m").alias("json"))


def write_json(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "ignore").json(path)


def write_paths(df: DataFrame, path: str, order: str, column: str) -> None:
    """A text dataset whose lines, in file order, are the column in the given order."""
    df.orderBy(order).select(F.col(column).cast("string").alias("value")).write.mode("ignore").text(path)


def list_images(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp", "webp")) -> DataFrame:
    """``path, length`` of image files below a folder, sorted; contents aren't read."""
    glob = "*.{" + ",".join([*extensions, *[e.upper() for e in extensions]]) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length").orderBy("path")


def first_by_suffix(columns: list[str], suffix: str) -> str | None:
    """First column whose name ends so."""
    return next((c for c in columns if c.endswith(suffix)), None)


def padded_id(column: Column, width: int = 10) -> Column:
    return F.lpad(column.cast("string"), width, "0")


def split_fields(column: Column, names: tuple[str, ...]) -> list[Column]:
    """Fields of an id of white-space separated parts."""
    parts = F.split(F.trim(column), r"\s+")
    return [parts[i].alias(n) for i, n in enumerate(names)]


def image_path(root: str, image_id: Column, degradation: Column, severity: Column) -> Column:
    """root/clean/id.png, or root/degraded/degradation/severity/id.png."""
    shifted = F.concat_ws("/", F.lit(root), F.lit("degraded"), degradation, severity.cast("string"), F.concat(image_id.cast("string"), F.lit(".png")))
    return F.when(degradation == "clean", F.concat_ws("/", F.lit(root), F.lit("clean"), F.concat(image_id.cast("string"), F.lit(".png")))).otherwise(shifted)


def frame_path(root: str, frame_id: Column, degradation: Column, severity: Column) -> Column:
    """Path of a "folder frame side" id: side l or r names the camera, frames are zero-padded, clean has no severity level."""
    folder, frame, side = (F.split(frame_id, " ")[i] for i in range(3))
    camera = F.when(side == "l", "image_02").when(side == "r", "image_03")
    level = F.when(degradation == "clean", F.lit("clean")).otherwise(F.concat_ws("/", degradation, severity.cast("string")))
    return F.concat_ws("/", F.lit(root), level, folder, camera, F.lit("data"), F.concat(padded_id(frame.cast("int")), F.lit(".png")))


def manifest(folders: DataFrame, embeddings: DataFrame, mode: str) -> DataFrame:
    """One row ``json``: mode, folder_ranges by tag (start, end, count), embeddings by space (n, d, seconds)."""
    f = folders.agg(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("start", "end", "count")))).alias("folder_ranges"))
    e = embeddings.agg(F.map_from_entries(F.collect_list(F.struct("space", F.struct("n", "d", "seconds")))).alias("embeddings"))
    return f.crossJoin(e).select(F.to_json(F.struct(F.lit(mode).alias("mode"), "folder_ranges", "embeddings")).alias("json"))


def write_results(spark: SparkSession, results: dict, path: str) -> None:
    """One JSON object as one file at ``path``, by any file system that Spark knows."""
    import json

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
    try:
        out.write(json.dumps(results, indent=2, default=_plain).encode())
    finally:
        out.close()


def _plain(x):
    return x.item() if isinstance(x, np.generic) else x.tolist() if isinstance(x, np.ndarray) else str(x)


def load_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``space, k, level, metric, value`` of nested result files (one JSON object each); missing files are skipped with a warning."""
    import warnings

    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    there = []
    for p in paths:
        path = hadoop(p)
        if path.getFileSystem(conf).exists(path):
            there.append(p)
        else:
            warnings.warn(f"no results at {p}", stacklevel=2)
    empty = "space string, k string, level string, metric string, value double"
    if not there:
        return spark.createDataFrame([], empty)
    facts = "map<string, map<string, map<string, map<string, double>>>>"
    text = spark.read.text(there, wholetext=True)  # with sections (config, sweep, ...) or the sweep alone
    raw = text.select(F.coalesce(F.from_json(F.get_json_object("value", "$.sweep"), facts), F.from_json("value", facts)).alias("m"))
    out = raw.select(F.explode("m").alias("space", "m")).select("space", F.explode("m").alias("k", "m"))
    return out.select("space", "k", F.explode("m").alias("level", "m")).select("space", "k", "level", F.explode("m").alias("metric", "value"))


def half_precision(df: DataFrame, column: str = "vec") -> DataFrame:
    """Vectors rounded to what 16-bit floats hold (the cache's precision), as doubles."""
    @F.pandas_udf("array<double>")
    def rounded(v: pd.Series) -> pd.Series:
        return v.map(lambda x: np.asarray(x, np.float16).astype(np.float64))

    return df.withColumn(column, rounded(column))
