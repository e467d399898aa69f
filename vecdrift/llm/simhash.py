r"""SimHash near-duplicates by covering locality-sensitive hashing (operator 4).

Fingerprints: 64-bit SimHash over XXH64 (seed 42) of three-word shingles, computed per document in Arrow batches.
Links: fingerprints at ``RADIUS`` = 3 or fewer differing bits. The structured masks of covering LSH give 15 tables: bit
position i carries a non-zero vector m(i) of GF(2)^4, and table v != 0 keeps the positions with <m(i), v> = 1. Three
vectors never span GF(2)^4, so some v is orthogonal to all differing positions: every pair within the radius collides
in that table - no probability, no misses.

Skew: equal fingerprints are one row before anything is bucketed. A bucket of more than ``HOT`` fingerprints is dealt
anew by 15 masks over the bits its table dropped (the same guarantee, as the rest of the bits agree), which leaves at
most about 2^14 fingerprints in any group. In a group, members are compared in numpy and only a spanning forest leaves
the task: at most size - 1 links, all true ones, connecting exactly what all pairs would. Components are contracted
round by round (each node joins the neighbour of least hash) with every round's tables in shared storage; joins there
are between plain scans, so adaptive execution can split a hot node. Nothing is collected to the driver.

:func:`near_dedup` goes on from there. Documents of five-word shingle similarity 0.8 differ in about ten of 64 bits;
covering that radius takes thousands of tables. So what the fingerprints leave, one document a component, is compared
once more: 128 min-hashes of the five-word shingles, 20 bands of five of them as buckets (a pair at 0.8 shares one with
probability 0.9996), and a link if the share of equal min-hashes is at least 0.8 less its standard error. A band's bucket
of more than ``HOT`` members is compared in pairs of blocks, so no link is lost in it. Of each component one document stays.

Defined results: null, empty or blank texts have fingerprint 0 and link like any other; texts of one or two words are
one shingle; a null doc_id takes part but names a component only if all its ids are null; repeated rows
give equal rows. Empty tables work. Extra columns pass through :func:`near_dedup`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

RADIUS = 3
SHINGLE = 3
SEED = 42
HOT = 2048
#: The second comparison of :func:`near_dedup`.
WORDS, SIMILAR = 5, 0.8
HASHES, BANDS = 128, 20
ROWS = 5
_EQUAL = int(np.ceil(HASHES * (SIMILAR - (SIMILAR * (1 - SIMILAR) / HASHES) ** 0.5)))
_ODD = (np.random.default_rng(SEED).integers(0, 1 << 63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: 1 - SHINGLE].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    n = len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)), np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.arange(64, dtype=np.uint64))[2 * counts > n].sum(dtype=np.uint64))


def min_hashes(text: str | None) -> np.ndarray:
    """``HASHES`` min-hashes of the text's five-word shingles (fewer words: the whole sequence; none: zeros)."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(HASHES, np.uint64)
    known = {w: xxh64_intdigest(w, SEED) for w in set(words)}
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WORDS + 1)
    x = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(h))):
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    x ^= x >> np.uint64(32)
    x = np.unique(x * np.uint64(0xD6E8FEB86659FD93))
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 1 << 11):
        few = x[at : at + (1 << 11), None] * _ODD
        np.minimum(out, few.min(axis=0), out=out)
    return out


def sketched(keyed: DataFrame, key: str, text_column: str) -> DataFrame:
    """``doc_id`` (the key), ``fp``, ``sketch`` (a byte a min-hash), ``bands``. Narrow."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            fp = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
            m = np.array([min_hashes(t) for t in texts], np.uint64).reshape(-1, HASHES)
            sketch = (m * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)
            bands = np.zeros((len(texts), BANDS), np.uint64)
            for k in range(ROWS):
                bands = (bands ^ (bands >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + m[:, k : k + ROWS * BANDS : ROWS]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS, dtype=np.int32)), pa.array(bands.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), pa.array([r.tobytes() for r in sketch], pa.binary()), lists], names=["doc_id", "fp", "sketch", "bands"])

    df = keyed.select(F.col(key).alias("doc_id"), F.col(text_column).cast("string").alias("t"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp bigint, sketch binary, bands array<bigint>")


def _similar(batches):
    """Sorted rows (v, k, w, l, node, sketch) -> a spanning forest of the links of each group."""
    key, nodes, sketches = None, [], []
    out: list[tuple[int, int]] = []

    def close():
        if len(nodes) < 2:
            return
        x = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, HASHES)
        left = np.arange(len(x))
        while len(left):
            queue, left = [int(left[0])], left[1:]
            while queue and len(left):
                i = queue.pop()
                near = (x[left] == x[i]).sum(axis=1) >= _EQUAL
                found = left[near].tolist()
                left = left[~near]
                out.extend((nodes[i], nodes[j]) for j in found)
                queue += found

    def batch():
        pairs = np.array(out, np.int64).reshape(-1, 2)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=["a", "b"])

    for b in batches:
        groups = zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)
        for now, node, sketch in zip(groups, b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
            if now != key:
                close()
                key, nodes, sketches = now, [], []
            nodes.append(node)
            sketches.append(sketch)
        if len(out) > 1 << 16:
            yield batch()
    close()
    yield batch()


def _compared(dealt: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links within the groups ``v, k, w, l`` of ``node``; sketches travel only where something is compared."""
    sketches = nodes.select(F.col("node").alias("n2"), "sketch")
    rows = dealt.join(sketches, F.col("node") == F.col("n2")).select("v", "k", "w", "l", "node", "sketch")
    return rows.repartition("v", "k", "w", "l").sortWithinPartitions("v", "k", "w", "l").mapInArrow(_similar, "a bigint, b bigint")


def similar_links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """``a, b``: links of ``node, sketch, bands`` that connect what all links within buckets of bands connect; some repeat.

    A bucket of more than ``hot`` members is dealt into blocks of about half as many. Block 0 first meets every other;
    where that leaves the bucket in more than one component, every two of the other blocks meet too.
    """
    keys = nodes.select("node", F.posexplode("bands").alias("v", "k"))
    counts = materialize(keys.groupBy("v", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands").select(F.col("v").alias("cv"), F.col("k").alias("ck"), "n")
    blocks = F.when(F.col("n") <= hot, F.lit(1)).otherwise(F.ceil(F.col("n") / F.lit(max(1, hot // 2)))).cast("int")
    members = keys.join(counts, (F.col("v") == F.col("cv")) & (F.col("k") == F.col("ck"))).select("v", "k", "node", blocks.alias("m"))
    members = materialize(members.withColumn("p", F.pmod(F.xxhash64("node", "v"), F.col("m")).cast("int")), "members")
    last = F.col("m") - 1
    met = F.when(F.col("p") == 0, F.sequence(F.least(F.lit(1), last), last)).otherwise(F.array("p"))
    first = _compared(members.select("v", "k", F.lit(0).alias("w"), F.explode(met).alias("l"), "node"), nodes)
    large = members.where("m > 2")
    if large.isEmpty():
        return first
    first = materialize(first, "links")
    large = large.join(components(first).withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left").withColumn("label", F.coalesce("label", "node"))
    parted = large.groupBy(F.col("v").alias("ov"), F.col("k").alias("ok")).agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    rest = large.where("p > 0").join(parted, (F.col("v") == F.col("ov")) & (F.col("k") == F.col("ok")), "left_semi")
    rest = rest.withColumn("q", F.explode(F.sequence(F.lit(1), last))).where("p <> q")
    return first.union(_compared(rest.select("v", "k", F.least("p", "q").alias("w"), F.greatest("p", "q").alias("l"), "node"), nodes))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp`` (the unsigned 64 bits as a long). Narrow."""

    def run(batches):
        for batch in batches:
            fp = np.fromiter((fingerprint(t) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    df = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("t"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(positions: list[int], radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks over the positions; any ``radius`` of them are all dropped by some mask."""
    vectors = (1 << radius + 1) - 1
    return [sum(1 << p for k, p in enumerate(positions) if (k % vectors + 1 & v).bit_count() % 2) for v in range(1, vectors + 1)]


MASKS = covering_masks(list(range(64)))
MASKS_2 = [covering_masks([p for p in range(64) if not mask >> p & 1]) for mask in MASKS]


def forest(x: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Places (i, j) of links within the radius that form a spanning forest of all such links."""
    links = []
    if len(x) == 2:
        return [(0, 1)] if int(x[0] ^ x[1]).bit_count() <= radius else []
    left = np.arange(len(x))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(x[left] ^ x[i]) <= radius
            if near.any():
                found = left[near].tolist()
                left = left[~near]
                links += [(i, j) for j in found]
                queue += found
    return links


def _links(batches):
    """Sorted rows (v, k, w, l, fp) -> links of each (v, k, w, l) group; holds one group (bounded) at a time."""
    names = ["a", "b"]
    group: list[np.ndarray] = []
    key = None

    def close():
        x = np.concatenate(group)
        return [(x[i], x[j]) for i, j in forest(x)] if len(x) > 1 else []

    out: list[tuple[int, int]] = []
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(4)]
        fp = batch.column(4).to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(fp):
            continue
        edge = np.flatnonzero(np.any([np.diff(c) != 0 for c in cols], axis=0)) + 1
        bounds = [0, *edge.tolist(), len(fp)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            now = tuple(int(c[a]) for c in cols)
            if now != key and group:
                out += close()
                group = []
            key = now
            group.append(fp[a:b])
        if len(out) > 1 << 16:
            yield _batch(out, names)
            out = []
    if group:
        out += close()
    yield _batch(out, names)


def _batch(links, names):
    pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], names=names)


def _tables(fps: DataFrame) -> DataFrame:
    masks = F.array(*[F.lit(_signed(m)).cast("long") for m in MASKS])
    return fps.select("fp", F.posexplode(masks).alias("v", "m")).select("v", F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """``a, b``: a spanning forest of the links within each bucket over distinct fingerprints ``fp``; some repeat."""
    counts = materialize(_tables(fps).groupBy("v", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    counts = counts.select(F.col("v").alias("cv"), F.col("k").alias("ck"), "n")
    members = _tables(fps).join(counts, (F.col("v") == F.col("cv")) & (F.col("k") == F.col("ck")), "inner").select("v", "k", "fp", "n")
    second = F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in ms]) for ms in MASKS_2])
    level = F.when(F.col("n") <= hot, F.array(F.lit(0).cast("long"))).otherwise(F.element_at(second, F.col("v") + 1))
    dealt = members.select("v", "k", "fp", "n", F.posexplode(level).alias("w", "m")).select("v", "k", "w", F.col("fp").bitwiseAND(F.col("m")).alias("l"), "fp")
    return dealt.repartition("v", "k", "w", "l").sortWithinPartitions("v", "k", "w", "l").mapInArrow(_links, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: a label for each node of ``a, b`` edges, equal exactly within a connected component.

    Each round every node takes the label of least hash among itself and its neighbours, hooked pointers are followed
    once more, and edges between different labels remain. Hashes change by round, so long chains shrink by a constant
    factor too. Ends when no edge is left.
    """
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    layers, turn = [], 0
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        both = edges.select(F.col("a").alias("u"), order("b").alias("x")).union(edges.select(F.col("b").alias("u"), order("a").alias("x")))
        hooked = materialize(both.groupBy("u").agg(F.min("x").alias("x")).select("u", F.least(F.col("x"), order("u"))["n"].alias("p")), "hooked")
        again = hooked.select(F.col("u").alias("u2"), F.col("p").alias("p2"))
        parents = materialize(hooked.join(again, F.col("p") == F.col("u2"), "left").select("u", F.coalesce("p2", "p").alias("p")), "parents")
        layers.append(parents)
        pa_, pb = parents.select(F.col("u").alias("ua"), F.col("p").alias("la")), parents.select(F.col("u").alias("ub"), F.col("p").alias("lb"))
        edges = edges.join(pa_, F.col("a") == F.col("ua")).join(pb, F.col("b") == F.col("ub")).where("la <> lb")
        edges = materialize(edges.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "edges")
        turn += 1
    if not layers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    out = layers[0].select(F.col("u").alias("node"), F.col("p").alias("label"))
    for layer in layers[1:]:
        out = materialize(out, "labels").join(layer, F.col("label") == F.col("u"), "left").select("node", F.coalesce("p", "label").alias("label"))
    return out


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: one row an input row."""
    return _classes(materialize(fingerprints(docs, id_column, text_column), "fingerprints"))


def _classes(own: DataFrame) -> DataFrame:
    fps = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    labels = components(links(fps.select("fp")))
    named = materialize(fps.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "named")
    least = materialize(named.groupBy("label").agg(F.min("least").alias("component_id")), "least").withColumnRenamed("label", "l2")
    of = materialize(named.join(least, F.col("label") == F.col("l2")).select(F.col("fp").alias("fp2"), "component_id"), "components")
    return own.join(of, F.col("fp") == F.col("fp2")).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: of those with the least id (null ids last) the one of least content hash."""
    keyed = docs.withColumn("__vd_h", F.xxhash64(F.col(text_column)))
    key = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col("__vd_h").alias("h"))
    own = materialize(sketched(keyed.withColumn("__vd_key", key), "__vd_key", text_column), "sketches")
    first = _classes(own).select(F.col("component_id").alias("key")).distinct()
    nodes = own.join(first, F.col("doc_id") == F.col("key")).groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("node", F.xxhash64("key")), "representatives")
    labels = components(similar_links(nodes)).withColumnRenamed("node", "n2")
    named = nodes.select("key", "node").join(labels, F.col("node") == F.col("n2"), "left")
    last = named.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("key").alias("key"))
    last = last.select(F.col("key.id").alias("__vd_id"), F.col("key.h").alias("__vd_h2"), F.xxhash64("key.none", "key.id", "key.h").alias("__vd_c2"))
    # one key column for the join and for repeated rows, so texts are shuffled once
    keyed = keyed.withColumn("__vd_c", F.xxhash64(F.col(id_column).isNull(), F.col(id_column), F.col("__vd_h")))
    same = F.coalesce(F.col(id_column) == F.col("__vd_id"), F.col(id_column).isNull() & F.col("__vd_id").isNull()) & (F.col("__vd_h").bitwiseXOR(F.col("__vd_h2")) == 0)
    rows = keyed.join(last, (F.col("__vd_c") == F.col("__vd_c2")) & same, "left_semi")
    return rows.dropDuplicates(["__vd_c", id_column, "__vd_h"]).select(*[F.col(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
