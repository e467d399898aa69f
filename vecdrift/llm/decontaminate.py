r"""Benchmark decontamination by n-gram windows (operator 5).

Items are lower-cased (A-Z only) and cut into words; every window of ``n`` consecutive words (an item of fewer words is
one window) goes into a hash set that is broadcast. Documents are scanned in Arrow batches: a word becomes its number
in the items' vocabulary (0: not in any item), runs of numbered words are hashed window by window with a rolling
polynomial in numpy, a bitmap passes a few of them, and those are verified word by word against the items.

The set is broadcast only while the items' text is at most ``block_bytes``. Larger benchmarks are cut into blocks of
that size, each its own broadcast, and the documents' hits of one block are written out before the next block reads
them (a stated query set against all rows, in blocks). Nothing is collected but the items of one block.

Defined results: null or empty texts have no words; items without words have no window and are never counted; rows
that share an item_id are one item; a null item_id counts as the text "null"; repeated documents give equal rows; empty tables work.
Extra columns pass through :func:`decontaminate` and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, materialize, text_or_empty

NGRAM = 10
#: About 300 bytes of Python objects a window: some 100 MB a worker.
BLOCK_BYTES = 2 << 20
_B = np.uint64(0x9E3779B97F4A7C15)
#: Bytes to themselves if they are in a word (lower-cased), else to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Items:
    """The windows of a block of items, looked up by rolling hash, verified by word numbers."""

    def __init__(self, rows: list[tuple[str, str | None]], n: int = NGRAM):
        self.vocabulary: dict[bytes, int] = {}
        self.windows: dict[tuple[int, ...], list[int]] = {}
        self.ids: list[str] = []
        for item_id, text in rows:
            numbers = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text))
            if not numbers:
                continue
            at = len(self.ids)
            self.ids.append(item_id)
            for i in range(max(1, len(numbers) - n + 1)):
                owners = self.windows.setdefault(numbers[i : i + n], [])
                if not owners or owners[-1] != at:
                    owners.append(at)
        self.lengths = sorted({len(w) for w in self.windows})
        self.tables = {}
        for length in self.lengths:
            own = [w for w in self.windows if len(w) == length]
            hashes = self.roll(np.array(own, dtype=np.uint64).reshape(-1), length)[::length] if own else np.zeros(0, np.uint64)
            bits = max(16, int(len(own) * 16).bit_length())
            bitmap = np.zeros(1 << bits, bool)
            bitmap[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.tables[length] = (np.uint64(64 - bits), bitmap, np.unique(hashes))

    @staticmethod
    def roll(numbers: np.ndarray, length: int) -> np.ndarray:
        """Hash of the ``length`` numbers from each place on."""
        m = len(numbers) - length + 1
        if m <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = np.zeros(m, np.uint64)
            for j in range(length):
                h *= _B
                h += numbers[j : j + m]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0x94D049BB133111EB)
        return h

    def hits(self, numbers: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, length, item) of every occurrence of a window in a sequence of word numbers."""
        found = []
        known = numbers > 0
        for length in self.lengths:
            if len(numbers) < length:
                continue
            shift, bitmap, hashes = self.tables[length]
            run = np.concatenate(([0], np.cumsum(known)))
            whole = np.flatnonzero(run[length:] - run[:-length] == length)
            if not len(whole):
                continue
            h = self.roll(numbers, length)[whole]
            near = bitmap[(h >> shift).astype(np.int64)]
            whole, h = whole[near], h[near]
            if not len(whole):
                continue
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in whole[hashes[at] == h].tolist():
                found += [(i, length, owner) for owner in self.windows.get(tuple(numbers[i : i + length].tolist()), ())]
        return found

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(words, hits) of each text; texts are hashed some megabytes at a time, with a 0 between them."""
        for few in chunks(texts):
            parts, counts = [], []
            for text in few:
                w = words_of(text)
                counts.append(len(w))
                parts += [np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.uint64, len(w)), np.zeros(1, np.uint64)]
            starts = np.concatenate(([0], np.cumsum(np.array(counts, dtype=np.int64) + 1)))
            out: list[list[tuple[int, int, int]]] = [[] for _ in few]
            for i, length, owner in self.hits(np.concatenate(parts)):
                k = int(np.searchsorted(starts, i, side="right")) - 1
                out[k].append((i - int(starts[k]), length, owner))
            yield from zip(counts, out, strict=True)


def _merged(runs: list[tuple[int, int]]) -> list[int]:
    """Half-open runs -> flat list of disjoint ascending start, end."""
    flat: list[int] = []
    for a, b in sorted(runs):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def _blocks(items: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """Blocks of items of bounded size. The size is checked by Spark before anything is collected."""
    rows = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("null")).alias("i"), text_or_empty(text_column).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t")).alias("s")).first()["s"] or 0
    n = -(-size // block_bytes) if size else 1
    if n == 1:
        yield [(r["i"], r["t"]) for r in rows.collect()]
        return
    dealt = materialize(rows.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(2 * n))), "items", "b")
    for b in range(2 * n):
        yield [(r["i"], r["t"]) for r in dealt.where(F.col("b") == b).collect()]


def find(
    docs: DataFrame, items: DataFrame, n: int = NGRAM, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of ``docs`` and ``__vd_words`` (count), ``__vd_runs`` (hit words as flat start, end pairs, disjoint
    and ascending), ``__vd_items`` (sorted distinct ids of the items with occurring windows). Narrow: no shuffle."""
    spark = docs.sparkSession
    made = [T.StructField("__vd_words", T.LongType()), T.StructField("__vd_runs", T.ArrayType(T.LongType())), T.StructField("__vd_items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *made])
    empty = {"__vd_words": F.lit(0).cast("long"), "__vd_runs": F.array().cast("array<long>"), "__vd_items": F.array().cast("array<string>")}
    out, first = docs.withColumns(empty), True
    for rows in _blocks(items, item_id_column, item_text_column, block_bytes):
        shared = spark.sparkContext.broadcast(Items(rows, n))

        def scan(batches, shared=shared):
            known: Items = shared.value
            for batch in batches:
                texts, was, had = (batch.column(c).to_pylist() for c in (text_column, "__vd_runs", "__vd_items"))
                n_words, runs, found = [], [], []
                for (count, hits), old, ids in zip(known.scan(texts), was, had, strict=True):
                    n_words.append(count)
                    runs.append(_merged([(i, i + length) for i, length, _ in hits] + list(zip(old[::2], old[1::2], strict=True))))
                    found.append(sorted({known.ids[k] for *_, k in hits}.union(ids)))
                columns = [pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *columns], names=batch.schema.names)

        out = (out if first else materialize(out, "hits")).mapInArrow(scan, schema)
        first = False
    return out


def decontaminate(docs: DataFrame, items: DataFrame, mode: str = "documents", text_column: str = "text", **options) -> DataFrame:
    """``docs`` without contamination, same columns: ``documents`` drops every document with a hit word; ``spans``
    replaces each hit run, from its first word's first to its last word's last character, by one line feed."""
    found = find(docs, items, text_column=text_column, **options)
    if mode == "documents":
        return found.where(F.size("__vd_runs") == 0).select(*[F.col(c) for c in docs.columns])
    if mode != "spans":
        raise ValueError(f"mode is documents or spans, not {mode!r}")

    def cut(batches):
        for batch in batches:
            names = batch.schema.names
            texts = [cut_runs(t, r) if r else t for t, r in zip(batch.column(text_column).to_pylist(), batch.column("__vd_runs").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(c).type) if c == text_column else batch.column(c) for c in names[:-3]], names=names[:-3])

    return found.mapInArrow(cut, docs.schema)


def cut_runs(text: str, runs: list[int]) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    kept, at = [], 0
    for a, b in zip(runs[::2], runs[1::2], strict=True):
        kept.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"\n".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    f = find(docs.select("doc_id", F.col("text").cast("string").alias("text")), items)
    hit = F.aggregate("__vd_runs", F.lit(0).cast("long"), lambda a, x: x - a)  # alternating sum: ends less starts
    return f.select(
        "doc_id", F.col("__vd_words").alias("n_words"), hit.alias("n_hit"), F.size("__vd_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__vd_items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS x
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS x
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw))
), h AS (
  SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x
), k AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r
), t AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""
