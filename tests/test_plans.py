import json

import numpy as np
import pytest

from vecdrift.operators import correlate as C
from vecdrift.operators import metrics
from vecdrift.plans import sweep
from vecdrift.sources import store

from .test_knn import frame


def test_sweep_shapes_and_bounds(spark):
    r = np.random.default_rng(0)
    real, near, far = r.normal(0, 1, (30, 4)), r.normal(0, 1, (25, 4)), r.normal(8, 1, (25, 4))
    rows = sweep.run_sweep(frame(spark, real), {"l2": frame(spark, far), "l1": frame(spark, near)}, [3], "pixel")
    got = {x["level"]: x for x in rows.collect()}
    assert list(got) == ["l1", "l2"]
    assert got["l1"]["baryshift_mean"] < got["l2"]["baryshift_mean"]
    for x in got.values():
        assert 0 <= x["overlap_mean"] <= 1 and x["n_communities"] >= 1 and x["n_edges"] >= 0
        # every choice lands somewhere: 55 nodes, 3 neighbours each
        assert (30 * x["indeg_real_mean"] + 25 * x["indeg_syn_mean"]) == pytest.approx(55 * 3)
    assert got["l2"]["overlap_mean"] == 1 and got["l2"]["nmi"] > got["l1"]["nmi"]
    facts = sweep.as_facts(rows)
    assert facts.columns == ["space", "k", "level", "metric", "value"]
    nested = json.loads(store.nested_results(facts).first()["json"])
    assert set(nested["pixel"]["3"]) == {"l1", "l2"}


def test_geometry_of_a_set_and_itself(spark):
    x = frame(spark, np.random.default_rng(1).normal(0, 1, (40, 3)))
    g = sweep.geometry(x, x, 5).first()
    assert g["shift_over_sigma"] == pytest.approx(0) and g["p2_log_er_ratio"] == pytest.approx(0) and g["p3_log_lid_ratio"] == pytest.approx(0)


def test_redundancy_needs_three_levels(spark):
    rows = [(s, f"l{i}", "m", float(i if s == "a" else -i)) for s in "ab" for i in range(3)] + [("c", "l0", "m", 1.0), ("c", "l1", "m", 2.0)]
    got = C.redundancy(spark.createDataFrame(rows, "space string, level string, metric string, value double")).collect()
    assert [(r["space_a"], r["space_b"], r["n"], round(r["rho"], 9)) for r in got] == [("a", "b", 3, -1.0)]


def test_dispatch(spark):
    pairs = spark.createDataFrame([(1, [1.0, 0.0], [1.0, 0.0])], "id bigint, a array<double>, b array<double>")
    assert metrics.paired("Cos@Inc", pairs).first()["value"] == pytest.approx(1) and metrics.paired("MSE", pairs).first()["value"] == 0
    for call in (lambda: metrics.paired("no", pairs), lambda: metrics.between_sets("no", pairs, pairs)):
        with pytest.raises(ValueError):
            call()
    x = frame(spark, np.random.default_rng(1).normal(0, 1, (12, 3)))
    got = {r["metric"]: r["value"] for r in metrics.set_metrics({"inception": (x, x), "dino": (x, x)}).collect()}
    assert got["FID"] == pytest.approx(0, abs=1e-6) and set(got) == {"FID", "KID", "FD@DINOv2", "KD@DINOv2"}


def test_missing_result_files_are_skipped(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"s": {"10": {"l": {"m": 1.5}}}}')
    with pytest.warns(UserWarning):
        got = store.load_results(spark, [str(tmp_path / "r.json"), str(tmp_path / "none.json")]).collect()
    assert [tuple(r) for r in got] == [("s", "10", "l", "m", 1.5)]


def test_sweep_from_files(spark, tmp_path):
    from vecdrift.sources import fbin

    r = np.random.default_rng(4)
    for space in ("pixel", "clip_vit_b32"):
        for tag, move in (("real", 0.0), ("l1", 0.2), ("l2", 1.0), ("l3", 4.0)):
            if (space, tag) != ("pixel", "l3"):
                (tmp_path / tag).mkdir(exist_ok=True)
                fbin.write(frame(spark, r.normal(move, 1, (24, 4))), str(tmp_path / tag / f"{space}.fbin"))
    with pytest.warns(UserWarning):
        out = sweep.run_from_fbins(spark, str(tmp_path), "real", ["l1", "l2", "l3"], ["pixel", "clip_vit_b32", "none"], [3, 5], str(tmp_path / "out.json"))
    assert set(out["sweep"]) == {"pixel", "clip_vit_b32"} and set(out["sweep"]["pixel"]) == {"3", "5"} and set(out["sweep"]["pixel"]["3"]) == {"l1", "l2"}
    assert json.loads((tmp_path / "out.json").read_text()).keys() == {"config", "sweep", "cross_space_redundancy", "k_sensitivity"}
    assert out["cross_space_redundancy"]["k_used"] == 3 and out["cross_space_redundancy"]["spearman"]["nmi"] == {}  # two common levels
    assert set(out["k_sensitivity"]["pixel"]) == set(sweep.SENSITIVITY)
    facts = store.load_results(spark, [str(tmp_path / "out.json")])
    assert facts.where("space = 'pixel' AND k = '3' AND level = 'l1' AND metric = 'nmi'").first()["value"] == pytest.approx(out["sweep"]["pixel"]["3"]["l1"]["nmi"])
    with pytest.warns(UserWarning):
        assert sweep.run_from_fbins(spark, str(tmp_path), "real", ["l1"], ["none"], [3]) == {}


def test_image_metrics_in_one_frame(spark):
    from vecdrift.operators import pixel as PX

    r = np.random.default_rng(0)
    a, b = r.integers(0, 256, (3, 12, 12)), r.integers(0, 256, (3, 12, 12))
    b[0] = a[0]
    pixels = spark.createDataFrame([(i, a[i].ravel().tolist(), b[i].ravel().tolist()) for i in range(3)], "id bigint, a array<int>, b array<int>")
    vectors = spark.createDataFrame([(i, r.random(4).tolist(), r.random(4).tolist()) for i in range(3)], "id bigint, a array<double>, b array<double>")
    frames = {n: vectors for n in metrics.IMAGE_METRICS} | {"pixels": pixels}
    out = metrics.image_metrics({("clean", 0): {}, ("dark", 2): frames}, 12, 12, [1.0] * 4)
    assert out.columns == ["degradation", "severity", "image_id", *metrics.IMAGE_METRICS] and len(metrics.IMAGE_METRICS) == 12
    got = {x["image_id"]: x for x in out.collect()}
    assert got[0]["SSIM"] == pytest.approx(1) and got[0]["TSI"] == got[0]["WD"] == 0 and got[0]["KL"] == pytest.approx(0) and got[0]["HistI"] == pytest.approx(1)
    long = spark.createDataFrame([(i, side, y, x, int(m[i, y, x])) for side, m in (("a", a), ("b", b)) for i in range(3) for y in range(12) for x in range(12)], "id bigint, side string, row int, col int, value int")
    for row in PX.texture_similarity(long, ["id"], "side").collect():
        assert got[row["id"]]["TSI"] == pytest.approx(row["tsi"], abs=1e-9)
    d = PX.density(long.where("id = 1"), "side")
    assert got[1]["KL"] == pytest.approx(PX.kl(d, "side", "a", "b").first()["kl"]) and got[1]["WD"] == pytest.approx(PX.sorted_density_distance(d, "side", "a", "b").first()["wd"])
    with pytest.raises(ValueError):
        metrics.metric("none", vectors)


def test_blur_and_hue():
    from vecdrift.operators import degrade as D

    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (20, 24, 3)).astype(float)
    spread = [D.blur(x, level, rng).std() for level in (1, 2, 3)]
    assert spread[0] > spread[1] > spread[2] and D.blur(np.full((16, 16), 7.0), 3, rng) == pytest.approx(np.full((16, 16), 7.0))
    import colorsys

    turned = D.turn_hue(x, 3, np.random.default_rng(1))
    by = np.random.default_rng(1).uniform(-0.5, 0.5)
    for p, q in zip(x.reshape(-1, 3)[:50], turned.reshape(-1, 3)[:50], strict=True):
        h, s, v = colorsys.rgb_to_hsv(*(p / 255))
        assert np.array(colorsys.hsv_to_rgb((h + by) % 1, s, v)) * 255 == pytest.approx(q)


def test_projection_cache(spark, tmp_path):
    from vecdrift.operators import presentation

    x = frame(spark, np.random.default_rng(0).normal(0, 1, (10, 3)))
    calls = []

    def project(sets):
        calls.append(1)
        return {n: s.selectExpr("id", "vec[0] AS x", "vec[1] AS y") for n, s in sets.items()}

    said = [presentation.cached_projection({"a": x}, str(tmp_path / "p"), project)[1] for _ in range(2)]
    other = frame(spark, np.random.default_rng(1).normal(0, 1, (10, 3)))
    out, last = presentation.cached_projection({"a": other}, str(tmp_path / "p"), project)
    assert [*said, last] == ["miss", "hit", "stale"] and len(calls) == 2 and out["a"].count() == 10
