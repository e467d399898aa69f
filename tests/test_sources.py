import json
import struct

import numpy as np
import pytest

from vecdrift import catalog
from vecdrift.operators import knn as K
from vecdrift.sources import fbin, store
from vecdrift.streaming import condition_mean_stream, confusion_stream

from .test_knn import frame


def test_fbin(spark, tmp_path):
    p = str(tmp_path / "a" / "x.fbin")
    x = np.random.default_rng(0).random((37, 5)).astype(np.float32)
    fbin.write_array(p, x)
    assert fbin.peek(p) == (37, 5)
    np.testing.assert_array_equal(fbin.read_array(p), x)
    np.testing.assert_array_equal(fbin.read_array(p, mmap=True), x)
    fbin.register(spark)
    rows = spark.read.format("fbin").option("rowsPerPartition", 10).load(p).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(37))
    np.testing.assert_array_equal(np.array([r["vec"] for r in rows], np.float32), x)
    q = str(tmp_path / "y.fbin")
    fbin.write(frame(spark, x).repartition(3), q)
    np.testing.assert_array_equal(fbin.read_array(q), x)
    assert sorted(f.name for f in tmp_path.iterdir()) == ["a", "y.fbin"]


def test_fbin_errors(tmp_path):
    p = tmp_path / "bad.fbin"
    p.write_bytes(struct.pack("<II", 3, 2) + bytes(20))
    with pytest.raises(ValueError):
        fbin.peek(str(p))
    p.write_bytes(b"abc")
    with pytest.raises(ValueError):
        fbin.peek(str(p))
    with pytest.raises(ValueError):
        fbin.write_array(str(p), np.ones(3))


def test_upsert_keeps_other_partitions(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    store.upsert_parquet(df, p, ["k"])
    store.upsert_parquet(spark.createDataFrame([("b", 9)], "k string, v int"), p, ["k"])
    assert {(r["k"], r["v"]) for r in spark.read.parquet(p).collect()} == {("a", 1), ("b", 9)}
    out = store.replace_partition(df, spark.createDataFrame([("b", 7)], "k string, v int"), ["k"])
    assert {(r["k"], r["v"]) for r in out.collect()} == {("a", 1), ("b", 7)}


def test_ranges_of_repeated_tags(spark):
    df = spark.createDataFrame([(0, "x", 3), (1, "y", 2), (2, "x", 4), (3, "x", 1)], "o int, t string, n int")
    got = [(r["tag"], r["start"], r["end"]) for r in store.ranges(df, "o", "t", "n").orderBy("start").collect()]
    assert got == [("x", 0, 3), ("y", 3, 5), ("x#1", 5, 9), ("x#2", 9, 10)]


def test_incomplete_and_remaining(spark):
    want = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "g string, i int")
    have = spark.createDataFrame([("a", 1), ("b", 1)], "g string, i int")
    assert [(r["g"], r["wanted"], r["have"]) for r in store.incomplete(want, have, ["g"], "i").collect()] == [("a", 2, 1)]
    assert [(r["g"], r["i"]) for r in store.remaining(want, have, ["g", "i"]).collect()] == [("a", 2)]


def test_json_nesting(spark, tmp_path):
    f = spark.createDataFrame([("s", 10, "l1", "m", 1.5), ("s", 10, "l1", "n", 2.0)], "space string, k int, level string, metric string, value double")
    df = store.nested_results(f)
    assert json.loads(df.first()["json"]) == {"s": {"10": {"l1": {"m": 1.5, "n": 2.0}}}}
    p = str(tmp_path / "j")
    store.write_json(df, p)
    store.write_json(df.limit(0), p)  # there already: kept
    assert spark.read.json(p).count() == 1


def test_image_listing_and_paths(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for n in ("b.png", "a.PNG", "d/c.jpg", "x.txt"):
        (tmp_path / n).write_bytes(b"1")
    names = [r["path"].rsplit("/", 1)[1] for r in store.list_images(spark, str(tmp_path)).collect()]
    assert sorted(names) == ["a.PNG", "b.png", "c.jpg"]
    out = str(tmp_path / "paths")
    store.write_paths(spark.createDataFrame([(2, "y"), (1, "x")], "o int, p string").coalesce(1), out, "o", "p")
    assert [r["value"] for r in spark.read.text(out).collect()] == ["x", "y"]
    assert store.first_by_suffix(["a/b_x", "c_y"], "_y") == "c_y" and store.first_by_suffix([], "z") is None


def test_catalog(spark):
    c = catalog.conditions(spark).orderBy("ordinal").collect()
    assert len(c) == 91 and (c[0]["degradation"], c[0]["severity"]) == ("clean", 0)
    assert catalog.metrics(spark).count() == 16
    assert K.space_metric("clip_vit_b32") == (True, "ip") and K.space_metric("pixel") == (False, "l2")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(0, 0), (0, 1), (255, 1)], "gt int, pred int").write.parquet(src)
    s = spark.readStream.schema("gt int, pred int").parquet(src)
    q = confusion_stream(s).writeStream.outputMode("complete").format("memory").queryName("cm").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["gt"], r["pred"], r["n"]) for r in spark.table("cm").collect()} == {(0, 0, 1), (0, 1, 1)}
    df = spark.createDataFrame([("fog", 1, 2.0), ("fog", 1, 4.0)], "degradation string, severity int, m double")
    assert condition_mean_stream(df, ["m"]).first()["m"] == 3
