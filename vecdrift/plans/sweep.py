"""The sweep: geometry and graph measures of a real set against shifted sets, over spaces, k and levels."""

from __future__ import annotations

import os
import warnings
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import correlate as C
from ..operators import knn as K
from ..operators import lid as L
from ..operators import neighborhood as N
from ..operators import partition as P
from ..sources import fbin, store
from ..sources.store import materialize


#: Measures compared between spaces, and across k.
REDUNDANCY = ("baryshift_mean", "lid_mean", "overlap_mean", "indeg_real_mean", "indeg_syn_mean", "nmi", "ari")
SENSITIVITY = ("baryshift_mean", "lid_mean", "overlap_mean", "nmi")


def pooled(real: DataFrame, gen: DataFrame) -> DataFrame:
    """``id, vec, is_gen, own_id``: generated ids are negative, so both sides keep theirs."""
    r = real.select("id", "vec", F.lit(False).alias("is_gen"), F.col("id").alias("own_id"))
    return r.unionByName(gen.select((-F.col("id") - 1).alias("id"), "vec", F.lit(True).alias("is_gen"), F.col("id").alias("own_id")))


def stats(df: DataFrame, column: str, name: str, median: bool = True) -> DataFrame:
    parts = [F.avg(column).alias(f"{name}_mean"), F.stddev_pop(column).alias(f"{name}_std")]
    return df.agg(*parts, *([F.percentile(column, F.lit(0.5)).alias(f"{name}_median")] if median else []))


def _at_once(jobs: list) -> list:
    """Results of independent Spark actions, submitted together."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return [x.result() for x in [pool.submit(job) for job in jobs]]


def _level(real: DataFrame, gen: DataFrame, k: int, metric: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pool, neighbours of generated rows among real ones, neighbours within the pool: one search each, for all k up to this one."""
    # pool ids: real as they are, generated below zero - the real-only search can be shared by all levels
    pool = materialize(pooled(real, gen), "pool")
    cross, mixed = _at_once([lambda: materialize(K.cross_set_knn(real, gen, k, metric), "cross"), lambda: materialize(K.mixed_knn(pool.select("id", "vec"), k, metric), "mixed")])
    return pool, cross, mixed


def _measures(real, gen, pool, cross, mixed, real_knn, k: int, metric: str) -> dict:
    """All measures of one (level, k): independent one-row aggregations."""
    cross, mixed, real_knn = (x.where(F.col("rank") <= k) for x in (cross, mixed, real_knn))
    # distances of the search become true ones before any logarithm
    to_real = cross.withColumn("distance", V.true_distance(F.col("distance"), metric))
    degree = N.in_degree(mixed, pool, k).join(pool.select("id", "is_gen"), "id")
    sides = [x for name, side in (("indeg_real", ~F.col("is_gen")), ("indeg_syn", F.col("is_gen"))) for x in (F.avg(F.when(side, F.col("in_degree"))).alias(f"{name}_mean"), F.stddev_pop(F.when(side, F.col("in_degree"))).alias(f"{name}_std"))]

    def graph():
        edges = materialize(N.mutual_graph(mixed, k), "mutual")
        labels = materialize(P.communities(edges, pool), "communities")
        table = materialize(P.contingency(labels.join(pool.select("id", "is_gen"), "id"), "is_gen", "label"), "contingency")
        parts = _at_once([lambda x=x: x.first().asDict() for x in (P.nmi(table), P.ari(table), P.modularity(edges, labels), labels.agg(F.countDistinct("label").alias("n_communities")), edges.agg(F.count(F.lit(1)).alias("n_edges")))])
        return {name: value for part in parts for name, value in part.items()}

    rows = [
        stats(N.barycenter_shift(cross, gen, real, k), "shift", "baryshift"),
        stats(L.lid(to_real, k), "lid", "lid"),
        stats(N.neighbor_overlap(real_knn, mixed.where("query_id >= 0"), k), "overlap", "overlap", median=False),
        degree.agg(*sides),
    ]
    parts = _at_once([graph, *[lambda x=x: x.first().asDict() for x in rows]])
    return {name: value for part in (*parts[1:], parts[0]) for name, value in part.items()}


def run_single(real: DataFrame, gen: DataFrame, k: int, space: str = "", real_knn: DataFrame | None = None) -> DataFrame:
    """One row of all measures for one (real, generated, k)."""
    return run_sweep(real, {"": gen}, [k], space, real_knn).drop("level")


def run_sweep(real: DataFrame, levels: dict[str, DataFrame], ks: list[int], space: str = "", real_knn: DataFrame | None = None) -> DataFrame:
    """A row of measures for each k and level (sorted as strings). Searches are done once a level, at the largest k."""
    normalise, metric = K.space_metric(space)
    if normalise:
        real, *rest = (x.withColumn("vec", V.l2_normalize(F.col("vec"))) for x in (real, *levels.values()))
        levels = dict(zip(levels, rest, strict=True))
    if not ks or not levels:
        raise ValueError("at least one k and one level are needed")
    names, most = sorted(levels), max(ks)
    first = [] if real_knn is not None else [lambda: materialize(K.mixed_knn(real, most, metric), "real")]
    found = _at_once([*[lambda n=n: _level(real, levels[n], most, metric) for n in names], *first])
    shared = real_knn if real_knn is not None else found.pop()
    rows = []
    for k in ks:
        for name, (pool, cross, mixed) in zip(names, found, strict=True):
            rows.append({"space": space, "k": k, **_measures(real, levels[name], pool, cross, mixed, shared, k, metric), "level": name})
    counts = ("k", "n_communities", "n_edges")
    schema = ", ".join(f"{n} " + ("string" if n in ("space", "level") else "bigint" if n in counts else "double") for n in rows[0])
    return real.sparkSession.createDataFrame([tuple(r.values()) for r in rows], schema)


def run_from_fbins(spark, folder: str, real_tag: str, level_tags: list[str], spaces: list[str], ks: list[int], output: str | None = None) -> dict:
    """The sweep over ``folder/tag/space.fbin`` files of several spaces, with redundancy and k-sensitivity.

    Spaces without a real file, and levels without theirs, are skipped with a warning; without any result the answer is
    empty and nothing is written. Else: config, sweep (space -> k -> level -> measures), cross_space_redundancy (rank
    correlation of each measure between spaces, at the least k, over three levels or more) and k_sensitivity (variation
    of each measure across k, mean over levels), as JSON too.
    """
    fbin.register(spark)

    def read(tag, space):
        path = f"{folder.rstrip('/')}/{tag}/{space}.fbin"
        if not os.path.isfile(path):
            warnings.warn(f"no vectors at {path}", stacklevel=3)
            return None
        return spark.read.format("fbin").load(path).select("id", F.col("vec").cast("array<double>").alias("vec"))

    all_rows = None
    for space in spaces:
        real = read(real_tag, space)
        levels = {tag: x for tag in level_tags if (x := read(tag, space)) is not None} if real is not None else {}
        if levels:
            rows = run_sweep(real, levels, ks, space)
            all_rows = rows if all_rows is None else all_rows.unionByName(rows)
    if all_rows is None:
        return {}
    facts = materialize(as_facts(all_rows), "sweep")
    sweep: dict = {}
    for r in facts.collect():
        sweep.setdefault(r["space"], {}).setdefault(str(r["k"]), {}).setdefault(r["level"], {})[r["metric"]] = r["value"]
    redundancy: dict = {}
    if len(sweep) > 1:
        spearman: dict = {name: {} for name in REDUNDANCY}
        for r in C.redundancy(facts.where((F.col("k") == min(ks)) & F.col("metric").isin(*REDUNDANCY)).drop("k")).collect():
            spearman[r["metric"]][f"{r['space_a']}_vs_{r['space_b']}"] = {"rho": r["rho"], "p_value": r["p"]}
        redundancy = {"spearman": spearman, "k_used": min(ks)}
    sensitivity: dict = {}
    for r in C.k_sensitivity(facts.where(F.col("metric").isin(*SENSITIVITY))).collect():
        sensitivity.setdefault(r["space"], {})[r["metric"]] = {"k_values": sorted(ks), "cv_across_k": r["cv"]}
    config = {"embeddings_dir": folder, "real_tag": real_tag, "level_tags": level_tags, "spaces": spaces, "k_values": ks}
    results = {"config": config, "sweep": sweep, "cross_space_redundancy": redundancy, "k_sensitivity": sensitivity}
    if output:
        store.write_results(spark, results, output)
    return results


def as_facts(rows: DataFrame) -> DataFrame:
    """Long form ``space, k, level, metric, value``."""
    names = [c for c in rows.columns if c not in ("space", "k", "level")]
    return rows.select("space", "k", "level", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["space", "k", "level"], names, "metric", "value")


def geometry(real: DataFrame, gen: DataFrame, k: int) -> DataFrame:
    """One row of set-level roll-ups: position, shape, dimension and mixing of a generated set against a real one."""
    from ..operators import moments as M

    spark = real.sparkSession
    position = M.position_shift(real, gen).select("shift_over_sigma", "shift_over_sigma_root_d")
    er, eg = M.effective_rank(real), M.effective_rank(gen)
    shape = spark.createDataFrame([(er, eg)], "p2_er_real double, p2_er_gen double").withColumn("p2_log_er_ratio", F.log(F.col("p2_er_gen") / F.col("p2_er_real")))

    def dimension(x, name):
        near = K.mixed_knn(x, k).withColumn("distance", V.true_distance(F.col("distance"), "l2"))
        return L.lid(near, k).agg(F.avg("lid").alias(f"p3_lid_{name}"))

    lids = dimension(real, "real").crossJoin(dimension(gen, "gen")).withColumn("p3_log_lid_ratio", F.log(F.col("p3_lid_gen") / F.when(F.col("p3_lid_real") > 0, F.col("p3_lid_real"))))
    pool = materialize(pooled(real, gen), "pool")
    m = N.mixing(K.mixed_knn(pool.select("id", "vec"), k), pool.select("id", "is_gen"), k)
    mixed = m.agg(F.avg(F.when(~F.col("is_gen"), F.col("mixing"))).alias("p5_rho_real"), F.avg(F.when(F.col("is_gen"), F.col("mixing"))).alias("p5_rho_gen"), F.avg("mixing").alias("p5_rho"))
    return position.crossJoin(shape).crossJoin(lids).crossJoin(mixed)
