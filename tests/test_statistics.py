import math

import numpy as np
import pytest

from vecdrift.operators import boxes as B
from vecdrift.operators import correlate as C
from vecdrift.operators import degrade as D
from vecdrift.operators import drops as R
from vecdrift.operators import extract as X
from vecdrift.operators import moments as M
from vecdrift.operators import partition as P
from vecdrift.operators import pixel as PX
from vecdrift.operators import presentation as S
from vecdrift.operators import taskperf as T

from .test_knn import frame


def test_moments(spark):
    x = np.random.default_rng(0).random((30, 4))
    n, mu, s = M.moments(frame(spark, x))
    np.testing.assert_allclose(mu, x.mean(axis=0))
    np.testing.assert_allclose(s / (n - 1), np.cov(x.T), atol=1e-12)
    assert 1 <= M.effective_rank(frame(spark, x)) <= 4
    assert M.effective_rank(frame(spark, np.outer(np.arange(5.0), [1, 2, 3]))) == pytest.approx(1)
    assert M.frechet(frame(spark, x), frame(spark, x)) == pytest.approx(0, abs=1e-6)
    assert M.frechet(frame(spark, x), frame(spark, x + 1)) == pytest.approx(4, abs=1e-6)
    with pytest.raises(ValueError):
        M.moments(frame(spark, x).limit(0))


def test_kid(spark):
    r = np.random.default_rng(0)
    x, y = r.random((9, 3)), r.random((7, 3))
    k = lambda a, b: (a @ b.T / 3 + 1) ** 3
    off = lambda m: (m.sum() - np.trace(m)) / (len(m) * (len(m) - 1))
    want = off(k(x, x)) + off(k(y, y)) - 2 * k(x, y).mean()
    assert M.kid(frame(spark, x), frame(spark, y), 3).first()["kid"] == pytest.approx(want)
    assert M._kid_sql(frame(spark, x), frame(spark, y), 3).first()["kid"] == pytest.approx(want)
    with pytest.raises(ValueError):
        M.kid(frame(spark, x[:1]), frame(spark, y), 3)


def test_pca(spark):
    x = np.random.default_rng(4).random((20, 5))
    mean, c = X.pca(frame(spark, x), 3)
    u = np.linalg.svd(x - x.mean(axis=0))[2][:3]
    np.testing.assert_allclose(np.abs((c * u).sum(axis=1)), 1, atol=1e-9)
    assert len(X.project(frame(spark, x), mean, c).first()["vec"]) == 3


def labels(spark, a, b):
    return spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")


def test_agreement(spark):
    same = P.contingency(labels(spark, [0, 0, 1, 1, 2], [5, 5, 3, 3, 4]), "a", "b")
    assert P.nmi(same).first()["nmi"] == pytest.approx(1) and P.ari(same).first()["ari"] == pytest.approx(1)
    one = P.contingency(labels(spark, [0, 0], [1, 1]), "a", "b")
    assert P.nmi(one).first()["nmi"] == 1 and P.ari(one).first()["ari"] == 1


@pytest.mark.parametrize("local", [500_000, 0])
def test_modularity_and_communities(spark, monkeypatch, local):
    monkeypatch.setattr(P, "LOCAL_EDGES", local)
    e = [(0, 1), (0, 2), (1, 2), (3, 4), (3, 5), (4, 5), (2, 3)]
    edges = spark.createDataFrame(e, "src bigint, dst bigint")
    l = spark.createDataFrame([(i, i // 3) for i in range(6)], "id bigint, label bigint")
    assert P.modularity(edges, l).first()["modularity"] == pytest.approx(2 * (3 / 7 - (7 / 14) ** 2))
    found = {r["id"]: r["label"] for r in P.communities(edges, l).collect()}
    assert found[0] == found[1] == found[2] and found[3] == found[4] == found[5] and found[0] != found[3]
    assert P.modularity(edges.limit(0), l).first()["modularity"] == 0


def test_communities_take_edges_without_objects(spark, monkeypatch):
    import tracemalloc

    monkeypatch.setattr(P, "louvain", lambda u, v, w: {0: 0})
    edges = spark.range(60_000).selectExpr("id div 6 AS src", "10000 + pmod(xxhash64(id), 10000) AS dst")
    arrow = spark.conf.get("spark.sql.execution.arrow.pyspark.enabled")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    tracemalloc.start()
    try:
        P.communities(edges, spark.range(20_000))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", arrow)
    assert peak < 5e6  # as objects 74 MB


def test_communities_are_the_same_in_memory_and_in_spark(spark, monkeypatch):
    r = np.random.default_rng(3)
    e = {(min(a, b), max(a, b)) for a, b in r.integers(0, 60, (160, 2)).tolist() if a != b and (a // 20 == b // 20 or r.random() < 0.1)}
    edges, nodes = spark.createDataFrame(sorted(e), "src bigint, dst bigint"), spark.range(62)
    found = []
    for most in (500_000, 20):
        monkeypatch.setattr(P, "LOCAL_EDGES", most)
        found.append({x["id"]: x["label"] for x in P.communities(edges, nodes).collect()})
    assert found[0] == found[1] and found[0][61] == 61 and all(c <= x for x, c in found[0].items())
    labels = spark.createDataFrame(list(found[0].items()), "id bigint, label bigint")
    assert P.modularity(edges, labels).first()["modularity"] > 0.45


def test_iou_absent_class(spark):
    cm = P.confusion(spark.createDataFrame([(0, 0), (0, 1), (255, 0), (2, 2)], "gt int, pred int"))
    got = {r["class"]: (r["iou"], r["present"]) for r in P.class_iou(cm).collect()}
    assert got == {0: (0.5, True), 1: (0.0, False), 2: (1.0, True)}
    assert P.miou(cm).first()["miou"] == pytest.approx(0.5)
    assert P.miou(cm, present_only=True).first()["miou"] == pytest.approx(0.75)


def test_ssim():
    x = np.random.default_rng(0).integers(0, 255, (12, 12)).astype(float)
    assert PX.ssim(x, x) == pytest.approx(1)
    y = np.clip(x + 40, 0, 255)
    w = [(x[i : i + 7, j : j + 7], y[i : i + 7, j : j + 7]) for i in range(6) for j in range(6)]
    c1, c2 = 6.5025, 58.5225
    want = np.mean([((2 * a.mean() * b.mean() + c1) * (2 * np.cov(a.ravel(), b.ravel())[0, 1] + c2)) / ((a.mean() ** 2 + b.mean() ** 2 + c1) * (a.var(ddof=1) + b.var(ddof=1) + c2)) for a, b in w])
    assert PX.ssim(x, y) == pytest.approx(want)


def test_constant_image_texture(spark):
    p = spark.createDataFrame([(0, r, c, 3) for r in range(2) for c in range(5)], "id int, row int, col int, value int")
    t = PX.texture(PX.glcm(p, ["id"], 1), ["id"]).first()
    assert (t["contrast"], t["homogeneity"], t["energy"], t["correlation"]) == (0, 1, 1, 1)


def polygon_area(p):
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True))) / 2


def clipped(a, b):
    out = [tuple(p) for p in a]
    for i in range(4):
        p, q = b[i], b[(i + 1) % 4]
        side = lambda z: (q[0] - p[0]) * (z[1] - p[1]) - (q[1] - p[1]) * (z[0] - p[0])  # noqa: B023, E731
        new = []
        for s, e in zip(out, out[1:] + out[:1], strict=True):
            if side(s) >= 0:
                new.append(s)
            if (side(s) >= 0) != (side(e) >= 0):
                u = side(s) / (side(s) - side(e))
                new.append((s[0] + u * (e[0] - s[0]), s[1] + u * (e[1] - s[1])))
        out = new
        if not out:
            return 0.0
    return polygon_area(out)


def test_rotated_overlap_against_clipping():
    r = np.random.default_rng(0)
    a = np.column_stack((r.random((300, 2)) * 4, r.random((300, 2)) * 3 + 0.2, r.random(300) * 6 - 3))
    b = a[r.permutation(300)]
    b[:40] = a[:40] + r.normal(0, 0.1, (40, 5))
    want = [clipped(x, y) for x, y in zip(B.corners(a).tolist(), B.corners(b).tolist(), strict=True)]
    np.testing.assert_allclose(B.intersection_area(a, b), want, atol=1e-9)
    # corners of a box turned clockwise, written out: half sides 2 and 1, sine 0.6, cosine 0.8
    turned = B.corners(np.array([[10, 20, 4, 2, np.arcsin(0.6)]]))[0]
    np.testing.assert_allclose(turned, [(12.2, 19.6), (9, 22), (7.8, 20.4), (11, 18)])
    assert B.overlap(np.array([[0, 0, 4, 2, 0.5]]), np.array([[1, 1, 4, 2, 0.5]]))[0] == pytest.approx(0.169, abs=1e-3)
    same = B.overlap(a, a)
    np.testing.assert_allclose(same, 1, atol=1e-9)
    touching = np.array([[0, 0, 2, 2, 0.0]]), np.array([[2, 0, 2, 2, 0.0]])
    assert B.overlap(*touching)[0] == 0
    inside = np.array([[0, 0, 4, 4, 0.3]]), np.array([[0, 0, 1, 1, 1.0]])
    assert B.overlap(*inside, 0)[0] == pytest.approx(1) and B.overlap(*inside, 1)[0] == pytest.approx(1 / 16) and B.overlap(*inside, 2)[0] == pytest.approx(1)
    assert B.overlap(np.zeros((0, 5)), np.zeros((0, 5))).shape == (0,)


def test_box_pairs_miss_none(spark):
    r = np.random.default_rng(1)
    a = np.column_stack((r.random((30, 2)) * 10 - 5, r.random((30, 2)) * 3 + 0.1, r.random(30) * 6))
    f = spark.createDataFrame([(i, x) for i, x in enumerate(a.tolist())], "id bigint, box array<double>")
    got = [(r["box_id"], r["query_id"]) for r in B.pairs_of(f, f, 2.0).collect()]
    assert len(got) == len(set(got))
    every = {(i, j) for i in range(30) for j in range(30) if B.overlap(a[i : i + 1], a[j : j + 1])[0] > 1e-9}
    assert every <= set(got)


def test_spearman(spark):
    rows = [("a", 1.0, 1.0), ("a", 2.0, 4.0), ("a", 3.0, 9.0), ("b", 1.0, 5.0), ("b", 1.0, 6.0), ("c", 1.0, 3.0), ("c", 2.0, 2.0), ("c", 2.0, 1.0), ("c", None, 0.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: (r["n"], r["rho"]) for r in C.spearman(df, "x", "y", ["g"]).collect()}
    assert got["a"] == (3, pytest.approx(1)) and "b" not in got and got["c"] == (3, pytest.approx(-math.sqrt(3) / 2))


def test_p_values():
    # two-sided t probabilities known in closed form: 1 and 2 degrees of freedom
    t = 0.5 * math.sqrt(1 / (1 - 0.25))
    assert C.p_value(0.5, 3) == pytest.approx(1 - 2 / math.pi * math.atan(t))
    t = 0.5 * math.sqrt(2 / (1 - 0.25))
    assert C.p_value(0.5, 4) == pytest.approx(1 - t / math.sqrt(2 + t * t))
    assert math.isnan(C.p_value(0.3, 2)) and C.p_value(1.0, 9) == 0


def test_fisher_clips(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (1.0,)], "rho double")
    assert df.agg(C.fisher_mean("rho").alias("r")).first()["r"] == pytest.approx(0.999999)


def test_complete_guard(spark):
    df = spark.createDataFrame([("i", 1.0), ("i", float("nan"))], "image_id string, drop double")
    with pytest.raises(ValueError):
        C.require_complete(df, ["image_id"], 2)
    C.require_complete(df.where("drop = 1"), ["image_id"], 1)


def test_drops(spark):
    s = spark.createDataFrame([("clean", 0, 2.0), ("fog", 1, 1.0)], "degradation string, severity int, score double")
    assert R.condition_drop(s, -1).first()["drop"] == 0.5
    zero = spark.createDataFrame([("clean", 0, 0.0), ("fog", 1, 1.0)], "degradation string, severity int, score double")
    assert R.condition_drop(zero, -1).first()["drop"] is None


def test_depth_and_entropy(spark):
    df = spark.createDataFrame([(2.0, 2.0), (4.0, 5.0)], "gt double, pred double")
    m = T.depth_metrics(df).first()
    assert m["abs_rel"] == pytest.approx(0.125) and m["a1"] == 0.5 and m["a2"] == 1
    assert T.median_scaled(df.withColumn("g", df["gt"] * 0), ("g",)).where("pred > 80").count() == 0
    e = spark.createDataFrame([([0.0, 0.0],), ([],)], "s array<double>").select(T.softmax_entropy(PX.F.col("s")).alias("e")).collect()
    assert e[0]["e"] == pytest.approx(math.log(2), abs=1e-9) and math.isnan(e[1]["e"])


def test_degrade(spark):
    x = frame(spark, np.full((3, 50), 128.0))
    a = {r["id"]: r["vec"] for r in D.degrade(x, "iso_noise", 2).collect()}
    b = {r["id"]: r["vec"] for r in D.degrade(x.repartition(3), "iso_noise", 2).collect()}
    assert a == b and all(0 <= v <= 255 and v == int(v) for row in a.values() for v in row)
    with pytest.raises(KeyError):
        D.degrade(x, "nothing", 1)


def test_fingerprint_changes(spark):
    x = np.random.default_rng(0).random((10, 2))
    y = x.copy()
    y[4, 1] += 1
    a, b, c = (S.fingerprint(frame(spark, v)).first()["sha256"] for v in (x, x, y))
    assert a == b != c


def test_extractor(spark):
    X.register("length", lambda: lambda contents: np.array([[len(c)] for c in contents]))
    df = spark.createDataFrame([(1, b"abc"), (2, b"")], "id bigint, content binary")
    assert {r["id"]: r["vec"] for r in X.extract(df, "length").collect()} == {1: [3.0], 2: [0.0]}
    with pytest.raises(ValueError):
        X.extract(df, "no such")


def test_axis_aligned_overlap_in_memory_and_by_cells(spark, monkeypatch):
    r = np.random.default_rng(8)
    b = np.column_stack((r.normal(0, 3, (40, 2)), r.uniform(0.5, 3, (40, 2)), np.zeros(40)))
    f = spark.createDataFrame([(i, x) for i, x in enumerate(b.tolist())], "id bigint, box array<double>")
    rows = lambda: {(x["box_id"], x["query_id"]): round(x["overlap"], 9) for x in B.axis_aligned_overlap(f, f.where("id % 5 = 0")).collect()}
    near = rows()
    monkeypatch.setattr(B, "MOST_QUERIES", 0)
    assert near == rows() and len(near) > 20


def test_pair_queries_take_every_fiftieth_query(spark):
    from vecdrift.plans import queries as Q

    for name in ("pairwise_l2", "pairwise_ip", "axis_aligned_iou"):
        rows = Q.QUERIES[name](spark, "/root/testdata/sf0.001").select("query_id").distinct().collect()
        assert rows and all(x["query_id"] % 50 == 0 for x in rows)
