"""The pipeline's stages on a small corpus, each held against what its predecessor kept."""

import numpy as np
import pytest

import corpus_pipeline as CP
from vecdrift.llm import decontaminate, mixing, simhash, token_output, toxicity

from .test_operators import near_brute, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for i in range(160):
        t = prose(i, 120)
        if i % 5 == 1:
            t += " idiot " + t.replace("alpha", "scum") + " idiot"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
        labels.append((i, 1, int(i % 5 == 1)))
    for k in range(8):
        rows.append((200 + k, rows[5 * k][1], "en", "s0", 0))  # exact copies
    passage = prose(999, 30)
    for k in range(6):
        rows.append((300 + k, prose(500 + k, 60) + " " + passage, "en", "s1", 0))
    rows.append((400, None, None, None, None))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(CP.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = (before, docs)
        if k < len(CP.STAGES) - 1:
            assert docs.columns == columns
    before, after = seen["toxicity"]
    kept = {r["doc_id"] for r in after.collect()}
    assert not {i for i in kept if i < 160 and i % 5 == 1}
    assert len({i for i in range(160) if i % 5 != 1} - kept) <= 3 and 400 in kept
    before, after = seen["simhash_near_dedup"]
    rows = before.collect()
    component = {r["doc_id"]: r["component_id"] for r in simhash.digest(before).collect()}
    want = set(near_brute([r["text"] for r in rows], [r["doc_id"] for r in rows], [component[r["doc_id"]] for r in rows]))
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(want)
    assert not {200 + k for k in range(8) if 5 * k in kept} & want
    before, after = seen["benchmark_decontamination"]
    import json

    hit = {r["doc_id"] for r in decontaminate.digest(before, spark.read.parquet(f"{folder}/benchmark.parquet")).where("contaminated").collect()}
    assert hit >= {300, 301} and {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect()} - hit
    before, after = seen["source_mixing"]
    plan = {r["doc_id"]: r["taken"] for r in mixing.digest(before).collect()}
    got = {}
    for r in after.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(r["text"].split())
    assert got == {k: v for k, v in plan.items() if v}
    before, after = seen["token_output"]
    texts = sorted((r["doc_id"], r["text"]) for r in before.collect())
    enc = token_output.Encoder(token_output.default_tokenizer()).tokenizer
    n = [len(enc.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts]
    rows = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in after.collect())
    assert [r[2] for r in rows] == n and [r[1] for r in rows] == [0, *np.cumsum(n)[:-1].tolist()]
    assert json.dumps(rows)


def test_run(spark, folder, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 60)
    out = CP.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
    assert CP.ORACLE_SQL is None and len(CP.STAGES) == 5
