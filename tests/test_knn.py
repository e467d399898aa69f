import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vecdrift.functions import vectors as V
from vecdrift.operators import knn as K
from vecdrift.operators import lid as L
from vecdrift.operators import neighborhood as N


def frame(spark, x, first=0):
    return spark.createDataFrame([(i + first, [float(v) for v in row]) for i, row in enumerate(np.asarray(x).tolist())], "id bigint, vec array<double>")


def brute(q, b, k, metric="l2", same=False):
    out = {}
    for i, x in enumerate(q):
        d = [(-float(np.dot(x, y)) if metric == "ip" else float(((x - y) ** 2).sum()), j) for j, y in enumerate(b) if not (same and i == j)]
        out[i] = sorted(d)[:k]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["distance"], r["neighbor_id"]))
    return out


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert [j for _, j in a[k]] == [j for _, j in b[k]]
        np.testing.assert_allclose([x for x, _ in a[k]], [x for x, _ in b[k]], atol=1e-9)


@pytest.mark.parametrize("method", ["block", "sql"])
@pytest.mark.parametrize(("metric", "n", "m", "d", "k"), [("l2", 12, 7, 4, 3), ("ip", 10, 5, 6, 4)])
def test_cross_set(spark, method, metric, n, m, d, k):
    r = np.random.default_rng(1)
    base, q = r.random((n, d)), r.random((m, d))
    close(got(K.cross_set_knn(frame(spark, base), frame(spark, q), k, metric, method=method)), brute(q, base, k, metric))


def test_grid_beyond_broadcast(spark, monkeypatch):
    monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(K, "BLOCK_ROWS", 7)
    x = np.random.default_rng(5).random((40, 3))
    close(got(K.mixed_knn(frame(spark, x), 4)), brute(x, x, 4, same=True))


@pytest.fixture
def many_partitions(spark):
    """Groups stay in the partitions that their keys' hashes name: nothing is put together afterwards."""
    own = {"spark.sql.shuffle.partitions": "13", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def test_grid_cells_meet_in_any_partition(spark, monkeypatch, many_partitions):
    monkeypatch.setattr(K, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(K, "BLOCK_ROWS", 11)
    x = np.random.default_rng(6).random((60, 3))
    close(got(K.mixed_knn(frame(spark, x), 4)), brute(x, x, 4, same=True))
    close(got(K.cross_set_knn(frame(spark, x), frame(spark, x[:30] + 0.1), 3)), brute(x[:30] + 0.1, x, 3))
    pairs = [(i, j) for i in range(60) for j in range(0, 60, 7) if i != j]
    out = K.ranks(frame(spark, x), spark.createDataFrame(pairs, "query_id bigint, neighbor_id bigint")).collect()
    places = {i: [j for _, j in sorted((float(((x[i] - y) ** 2).sum()), j) for j, y in enumerate(x) if j != i)] for i in range(60)}
    assert {(r["query_id"], r["neighbor_id"]): r["rank"] for r in out} == {(i, j): places[i].index(j) + 1 for i, j in pairs}


def test_broadcast_is_searched_in_place(spark):
    """Rows come by id, so no worker copies the broadcast's matrix; a search holds two tiles of products at most."""
    import tracemalloc

    x = np.random.default_rng(7).random((4096, 5))
    ids, vecs = K._collected(frame(spark, x).repartition(5).orderBy("vec"), 5)
    assert ids.tolist() == list(range(len(x))) and (vecs == x).all()
    base = K._Base(ids, vecs, "l2", 10)
    assert base.rows is vecs and K._Ranks(ids, vecs).base.rows is vecs
    tracemalloc.start()
    try:
        base.top_k(ids[:1024], vecs[:1024], 10, True)
        assert tracemalloc.get_traced_memory()[1] < 90e6  # a tile is 34 MB; three of them before
    finally:
        tracemalloc.stop()
    mixed = np.random.default_rng(0).permutation(len(x))
    a, b = (K._Ranks(ids[o], vecs[o]).before(ids[:2], vecs[:2], [np.array([5, 9]), np.array([700])]) for o in (ids, mixed))
    assert a.equals(b)


def test_mahalanobis_identity_and_full(spark):
    r = np.random.default_rng(7)
    base, q = r.random((8, 3)), r.random((6, 3))
    same = K.cross_set_knn(frame(spark, base), frame(spark, q), 2, "mahalanobis", inv_cov=np.eye(3))
    close(got(same), brute(q, base, 2))
    a = r.random((3, 3))
    inv = a @ a.T + np.eye(3)
    full = got(K.cross_set_knn(frame(spark, base), frame(spark, q), 2, "mahalanobis", inv_cov=inv))
    want = {i: sorted((float((x - y) @ inv @ (x - y)), j) for j, y in enumerate(base))[:2] for i, x in enumerate(q)}
    close(full, want)
    with pytest.raises(ValueError):
        K.cross_set_knn(frame(spark, base), frame(spark, q), 2, "mahalanobis")


def test_mixed_excludes_self_not_duplicates(spark):
    x = np.random.default_rng(33).random((15, 4))
    x[3] = x[9]
    g = got(K.mixed_knn(frame(spark, x), 3))
    close(g, brute(x, x, 3, same=True))
    assert all(i != j for i, v in g.items() for _, j in v)
    assert g[3][0][1] == 9


def test_ties_by_id(spark):
    g = got(K.cross_set_knn(frame(spark, [[5.0], [5.0], [3.0]]), frame(spark, [[0.0]]), 2))
    assert [j for _, j in g[0]] == [2, 0]


def test_nan_rows_never_enter(spark):
    g = got(K.cross_set_knn(frame(spark, [[1.0], [float("nan")], [2.0]]), frame(spark, [[0.0]]), 3))
    assert [j for _, j in g[0]] == [0, 2]


def test_argument_checks(spark):
    x = frame(spark, np.ones((3, 2)))
    for k in (0, 3):
        with pytest.raises(ValueError):
            K.mixed_knn(x, k)
    with pytest.raises(ValueError):
        K.cross_set_knn(x, frame(spark, np.ones((3, 4))), 1)
    with pytest.raises(ValueError):
        K.cross_set_knn(x.limit(0), x, 1)
    with pytest.raises(ValueError):
        K.knn(x, x, 1, "cosine")
    with pytest.raises(ValueError):
        K.pairwise_distances(x, metric="mahalanobis")


def neighbors(spark, rows):
    return spark.createDataFrame([(i, j, float(d), j + 1) for i, row in enumerate(rows) for j, d in enumerate(row)], "query_id bigint, neighbor_id bigint, distance double, rank bigint")


def test_lid_golden(spark):
    rows = [[0.5, 0.5, 0.5, 0.5, 0.6, 0.7], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [0, 0, 0, 0, 0, 0]]
    v = {r["query_id"]: r["lid"] for r in L.lid(neighbors(spark, rows), 4).collect()}
    assert v[0] == 0 and v[2] == 0
    assert v[1] == pytest.approx(0.844907, abs=1e-6)
    assert all(r["lid"] == 0 for r in L.lid(neighbors(spark, rows), 2).collect())


def test_twonn_needs_ten(spark):
    r = L.twonn(neighbors(spark, [[1.0, 2.0]] * 9)).first()
    assert np.isnan(r["twonn"]) and r["m"] == 9
    ratios = np.linspace(1.1, 3, 20)
    r = L.twonn(neighbors(spark, [[1.0, x] for x in ratios])).first()
    m, keep = 20, 18
    x, y = np.log(ratios[:keep]), -np.log(1 - np.arange(1, keep + 1) / m)
    assert r["twonn"] == pytest.approx((x * y).sum() / (x * x).sum())


def test_normalize_zero_vector(spark):
    out = frame(spark, [[0.0, 0.0], [3.0, 4.0]]).select(V.l2_normalize(V.F.col("vec")).alias("v")).collect()
    assert out[0]["v"] == [0, 0] and out[1]["v"] == pytest.approx([0.6, 0.8])


def ranks(x):
    n = len(x)
    out = np.zeros((n, n), int)
    for i in range(n):
        order = sorted((((x[i] - x[j]) ** 2).sum(), j) for j in range(n) if j != i)
        for r, (_, j) in enumerate(order, 1):
            out[i, j] = r
    return out


@pytest.mark.parametrize("method", ["block", "sql"])
@pytest.mark.parametrize("k", [2, 6])
def test_preservation(spark, k, method):
    r = np.random.default_rng(3)
    x, y = r.random((10, 3)), r.random((10, 3))
    rx, ry = ranks(x), ranks(y)
    norm = N.normalizer(10, k)
    out = {r["id"]: r for r in N.neighborhood_preservation(frame(spark, x), frame(spark, y), k, method).collect()}
    for i in range(10):
        t = sum(rx[i, j] - k for j in range(10) if j != i and ry[i, j] <= k < rx[i, j])
        c = sum(ry[i, j] - k for j in range(10) if j != i and rx[i, j] <= k < ry[i, j])
        assert out[i]["trustworthiness"] == pytest.approx(1 - norm * t)
        assert out[i]["continuity"] == pytest.approx(1 - norm * c)


@pytest.mark.parametrize("tiles", [(7, 5, 3), (K._TILE, K._QUERIES, K._PAIRS)])
@pytest.mark.parametrize("kind", ["ties", "odd", "equal", "far", "huge"])
def test_ranks_counted_in_tiles(monkeypatch, kind, tiles):
    for name, value in zip(("_TILE", "_QUERIES", "_PAIRS"), tiles, strict=True):
        monkeypatch.setattr(K, name, value)
    r = np.random.default_rng(5)
    x, ids = r.integers(0, 3, (60, 3)).astype(float), r.permutation(60) * 3
    if kind == "odd":
        x[11, 1], x[20, 0], x[21, 2], x[30] = np.inf, np.nan, -np.inf, np.nan
    if kind == "equal":
        x[:] = 0.1
    if kind == "far":
        x = 1e6 + 1e-3 * x
    if kind == "huge":
        x[:30] *= np.resize([1e200, 1e149, 1e145], (30, 1))
    lists = [ids[(ids != i) & (r.random(60) < 0.4)] for i in ids]
    got = K._Ranks(ids, x).before(ids, x, lists)
    with np.errstate(all="ignore"):
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i, (q, near) in enumerate(zip(ids.tolist(), lists, strict=True)):
        order = [ids[j] for j in np.lexsort((ids, d[i], np.isnan(d[i]))) if ids[j] != q]
        mine = got[got["query_id"] == q]
        assert mine["neighbor_id"].tolist() == near.tolist()
        assert mine["before"].tolist() == [order.index(j) for j in near]


@pytest.mark.parametrize("room", [K.BROADCAST_BYTES, 0])
def test_preservation_of_odd_rows(spark, monkeypatch, room):
    monkeypatch.setattr(K, "BROADCAST_BYTES", room)
    monkeypatch.setattr(K, "BLOCK_ROWS", 9)
    r = np.random.default_rng(8)
    x, y = r.integers(0, 4, (24, 3)).astype(float), r.integers(0, 4, (24, 3)).astype(float)
    x[3, 0], x[7, 1], y[5, 2], y[7, 0] = np.nan, np.inf, np.nan, 1e200
    k, norm, order = 4, N.normalizer(24, 4), []
    for m in (x, y):
        with np.errstate(all="ignore"):
            d = ((m[:, None] - m[None]) ** 2).sum(axis=2)
        order.append([[j for j in np.lexsort((np.arange(24), e, np.isnan(e))) if j != i] for i, e in enumerate(d)])
    out = {p["id"]: p for p in N.neighborhood_preservation(frame(spark, x), frame(spark, y), k, "sql").collect()}
    for i, (rx, ry) in enumerate(zip(*order, strict=True)):
        t, c = (sum(a.index(j) + 1 - k for j in b[:k] if j not in a[:k]) for a, b in ((rx, ry), (ry, rx)))
        assert out[i]["trustworthiness"] == pytest.approx(1 - norm * t)
        assert out[i]["continuity"] == pytest.approx(1 - norm * c)


def test_preservation_deals_no_pairs(spark):
    r = np.random.default_rng(6)
    out = N.neighborhood_preservation(frame(spark, r.random((50, 3))), frame(spark, r.random((50, 3))), 3, "sql")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Window" not in plan


def test_preservation_identity_and_degenerate(spark):
    x = frame(spark, np.random.default_rng(2).random((8, 2)))
    assert all(r["trustworthiness"] == 1 == r["continuity"] for r in N.neighborhood_preservation(x, x, 3).collect())
    assert all(np.isnan(r["trustworthiness"]) for r in N.neighborhood_preservation(x, x, 7).collect())
    for bad, k in ((x.limit(3), 2), (x, 0), (x, 8), (x.withColumn("id", x["id"] + 1), 2)):
        with pytest.raises(ValueError):
            N.neighborhood_preservation(x, bad, k)


def test_mixing_separated_is_zero(spark):
    x = np.concatenate((np.random.default_rng(1).random((8, 2)), 100 + np.random.default_rng(2).random((8, 2))))
    f = frame(spark, x)
    o = f.select("id", (f["id"] >= 8).alias("is_gen"))
    assert {r["mixing"] for r in N.mixing(K.mixed_knn(f, 3), o, 3).collect()} == {0.0}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(5, 20), st.integers(1, 4), st.integers(0, 99))
def test_in_degree_sums(spark, n, k, seed):
    x = frame(spark, np.random.default_rng(seed).random((n, 2)))
    near = K.mixed_knn(x, k)
    d = N.in_degree(near, x, k)
    assert sum(r["in_degree"] for r in d.collect()) == n * k
    assert all(r["overlap"] == 1 for r in N.neighbor_overlap(near, near, k).collect())
    assert all(r["src"] < r["dst"] for r in N.mutual_graph(near, k).collect())


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_ties_over_the_candidates(metric, exclude_self):
    r = np.random.default_rng(4)
    x = np.concatenate((np.repeat(r.normal(size=(3, 6)) + 50, 60, axis=0), r.normal(size=(40, 6))))
    ids = r.permutation(len(x))
    got = K.top_k(ids, x, ids, x, 5, metric, exclude_self)
    exact = -np.einsum("ij,kj->ik", x, x) if metric == "ip" else ((x[:, None] - x[None]) ** 2).sum(axis=2)
    for i, q in enumerate(ids):
        order = [j for j in np.lexsort((ids, exact[i])) if not exclude_self or j != i][:5]
        mine = got[got["query_id"] == q]
        assert mine["neighbor_id"].tolist() == ids[order].tolist() and np.allclose(mine["distance"], exact[i][order])


def test_vectors_far_from_the_origin(spark):
    r = np.random.default_rng(9)
    x = frame(spark, 1e6 + r.normal(0, 1e-3, (400, 6)))
    block, sql = (K.mixed_knn(x, 5, method=m).collect() for m in ("block", "sql"))
    assert sorted((a["query_id"], a["rank"], a["neighbor_id"]) for a in block) == sorted((a["query_id"], a["rank"], a["neighbor_id"]) for a in sql)


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_work_space_of_a_search_is_bounded(metric):
    import tracemalloc

    r = np.random.default_rng(3)
    b, ids = r.random((40_000, 4)), np.arange(40_000)
    tracemalloc.start()
    near = K.top_k(ids[:1024], b[:1024], ids, b, 5, metric, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(near) == 5 * 1024
    assert peak < 160e6  # all products at once are 328 MB


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_tiles_meet_in_one_order(monkeypatch, metric):
    monkeypatch.setattr(K, "_TILE", 7)
    monkeypatch.setattr(K, "_QUERIES", 5)
    r = np.random.default_rng(4)
    b, ids = r.integers(0, 3, (60, 3)).astype(float), r.permutation(60) * 3
    b[11, 1], b[20, 0] = np.inf, np.nan
    near = K.top_k(ids, b, ids, b, 12, metric, True)
    for i, x in zip(ids.tolist(), b, strict=True):
        d = [(-float(x @ y) if metric == "ip" else float(((x - y) ** 2).sum()), j) for j, y in zip(ids.tolist(), b, strict=True) if j != i]
        want = sorted(p for p in d if np.isfinite(p[0]))[:12]
        assert [(d, j) for d, j in near[near["query_id"] == i][["distance", "neighbor_id"]].itertuples(index=False)] == want


@pytest.mark.parametrize("kind", ["equal rows", "equal distances"])
def test_work_space_of_many_ties_is_bounded(kind):
    import tracemalloc

    b, ids = np.zeros((8192, 4)), np.arange(8192)
    b[:, 1] = 1
    if kind == "equal distances":  # signs differ: other rows, no two equal distances to the queries but these
        b[:, 0] = np.linspace(-1e-9, 1e-9, 8192)
        b[::2, 1] = -1
    q = np.zeros((1024, 4))
    tracemalloc.start()
    near = K.top_k(ids[:1024] + 10_000, q, ids, b, 5, "l2", False)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    exact = ((q[0] - b) ** 2).sum(axis=1)
    assert near["neighbor_id"].tolist() == np.lexsort((ids, exact))[:5].tolist() * 1024
    assert peak < 250e6  # all candidates of a tile at once take over 450 MB


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("exclude_self", [True, False])
def test_equal_rows_out_of_reach_change_nothing(metric, exclude_self):
    r = np.random.default_rng(8)
    x = r.integers(0, 2, (300, 2)).astype(float)  # four rows, about 75 times each
    ids = r.permutation(150).repeat(2)  # two rows an id
    assert K._in_reach(np.sort(ids), x[np.argsort(ids, kind="stable")], 4).sum() == 4 * 6
    assert len(K._Base(ids, x, metric, 4).ids) == 24
    few, whole = (b.top_k(ids, x, 4, exclude_self) for b in (K._Base(ids, x, metric, 4), K._Base(ids, x, metric)))
    assert few.equals(whole)
    assert few["neighbor_id"].nunique() < 20
