r"""Suffix-array dedup of long repeated strings (operator 7).

A byte goes if a string of ``LENGTH`` = 400 bytes covers it that starts at another place too, in any text. Beside that,
repeated passages of ``PASSAGE`` = 51 words are reported: a passage begins with a word, holds 51 words (more if those
are under ``SHORTEST`` = 256 bytes, at most 400 bytes) and repeats if equal ones begin with a word at two places.

1. Equal texts are merged first (one row and a count each); a text that occurs twice is covered whole.
2. Candidates: every window of 256 bytes picks an anchor, its 32-byte gram of least hash (leftmost). Equal windows pick
   equal grams, so only windows whose anchor's gram was picked at two places anywhere can repeat. That is one counting
   aggregation over about one long in 113 bytes; texts don't move.
3. The windows of each repeated anchor leave as one segment (at most 624 bytes), dealt out by the anchor's hash: windows
   that could be equal meet in one task. There segments are gathered to ``SHARD`` bytes; those in which no window's
   64-bit digest comes twice hold no repeat and go (nine in ten). The suffix array of the rest is built by
   Larsson-Sadakane refinement in numpy (8-byte start, doubling, groups of one left alone, ending at depth 512), its
   common prefixes by Kasai's lemma in permuted form (only where the predecessor isn't the neighbour's predecessor or
   the bytes before the two differ, all such places at once, the rest by subtraction). Neighbours of 400 common bytes
   form classes; window classes of two or more places are repeats. Passages, of unequal lengths, are told apart by
   128-bit digests. An anchor with more segments than a shard holds fills several; their windows are merged across
   shards by binary search in sorted digests, and what is found is compared byte by byte.
4. Anchors at more than ``HOT`` places (one passage in a third of all texts; over about 10 MB of segments) would fill a
   task. Their windows are counted by 128-bit digests in a global aggregation - a repeated passage is one row a map
   task there - and joined back.

All joins with the texts use a table bucketed by text key in shared storage, so texts are shuffled once.

Defined results: null and empty texts have 0 bytes and nothing to remove; texts under 400 bytes lose nothing; rows that
repeat a text of 400 bytes or more lose all of it, each; an empty table gives no rows. Matches never cross documents.
What remains of a text may be cut inside a character; it is a byte string. A text may have any length: anchors are
picked some million windows at a time. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import delete_now
from .common import delete_at_exit, materialize, shared_dir, text_or_empty

LENGTH, GRAM = 400, 32
PASSAGE, SHORTEST = 51, 256
SHARD = 1 << 21
HOT = 16_384
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_STEPS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_PLACE_BITS = np.uint64(28)
_SPACES = np.array([c in b"\x20\x09\x0a\x0b\x0c\x0d\xff" for c in range(256)], bool)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h *= _MIX[0]
    h ^= h >> np.uint64(29)
    h *= _MIX[1]
    h ^= h >> np.uint64(32)
    return h


def grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the 32 bytes from each place on, by five doublings."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _STEPS[0]
    size = 1
    for c in _STEPS:
        h = h[:-size] * c + (h[size:] ^ (h[size:] >> np.uint64(31)))
        size *= 2
    return _mixed(h)


def anchors(raws: list[bytes], size: int = SHORTEST, step: int = 1 << 22) -> tuple[np.ndarray, ...]:
    """Text, hash, place, first and last window of each anchor; each window of ``size`` bytes of a text has exactly one."""
    parts: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.uint64 if k == 1 else np.int64) for k in range(5))]
    few: list[int] = []
    held = 0

    def together():
        buf = np.frombuffer(b"".join(raws[i] for i in few), np.uint8)
        ends = np.cumsum([len(raws[i]) for i in few])
        h, at, first, last = _anchors(buf, ends, size)
        owner = np.searchsorted(ends, at, side="right")
        begin = (ends - [len(raws[i]) for i in few])[owner]
        parts.append((np.array(few)[owner], h, at - begin, first - begin, last - begin))
        few.clear()

    for i, raw in enumerate(raws):
        if few and held + len(raw) > 1 << 16:
            together()
            held = 0
        if len(raw) > step + size:
            parts.append(_in_parts(raw, i, size, step))
        elif len(raw) >= size:
            few.append(i)
            held += len(raw)
    if few:
        together()
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _in_parts(raw: bytes, i: int, size: int, step: int) -> tuple[np.ndarray, ...]:
    """The anchors of a long text, ``step`` windows at a time."""
    buf = np.frombuffer(raw, np.uint8)
    found = []
    for at in range(0, len(buf) - size + 1, step):
        own = buf[at : at + step + size - 1]
        found.append([x + at if k else x for k, x in enumerate(_anchors(own, np.array([len(own)]), size))])
    h, at, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = at[1:] != at[:-1]  # else one anchor on both sides of a cut
    begins = np.flatnonzero(new[:-1])
    return np.full(len(begins), i), h[begins], at[begins], first[begins], last[new[1:]]


def _anchors(buf: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Of texts side by side, each of ``size`` bytes or more."""
    h = grams(buf)
    width = size - GRAM + 1
    n = len(h) - width + 1
    places = np.arange(len(h), dtype=np.uint64)
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    key = (h & ~mask) | places
    # minimum of each run of ``width`` keys: of a block's rest and the next block's beginning
    full = -(-len(key) // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    begun = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    chosen = (np.minimum(rest[:n], begun[width - 1 : width - 1 + n]) & mask).astype(np.int64)
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():
        inside[e - size + 1 : e] = False
    windows = np.flatnonzero(inside)
    chosen = chosen[windows]
    begins = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    first, last = windows[begins], windows[np.concatenate((begins[1:], [len(windows)])) - 1]
    at = chosen[begins]
    return h[at], at, first, last


def suffix_array(buf: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes, sorted at least to ``depth`` bytes, and the 8 bytes from each place on (big-endian)."""
    n = len(buf)
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    word = np.zeros(n, np.uint64)
    for j in range(8):
        word = word << np.uint64(8) | padded[j : j + n]
    order = np.argsort(word)
    ordered = word[order]
    new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    slots = np.arange(n)
    h = 8
    while h < depth:
        ends = np.concatenate((new[1:], [True]))
        open_ = ~(new & ends)
        slots, new = slots[open_], new[open_]
        if not len(slots):
            break
        who = order[slots]
        after = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        key = rank[who] << 32 | after
        s = np.argsort(key)
        who, key = who[s], key[s]
        order[slots] = who
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[who] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        h *= 2
    return order, word


def common_prefixes(order: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix (by text place) with its predecessor in the order, whole at any length."""
    n = len(order)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    own = np.ones(n, bool)
    # the left neighbour's prefix is longer by one only if it has one: a predecessor that begins with the same byte
    front = word >> np.uint64(56)
    own[1:] = (before[1:] != before[:-1] + 1) | (before[:-1] < 0) | (front[:-1] != front[before[:-1]])
    at = np.flatnonzero(own & (before >= 0))
    other = before[at]
    found = np.zeros(n, np.int64)
    size = np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    step = 0
    while len(live):
        a, b = at[live] + step, other[live] + step
        inside = np.maximum(a, b) < n
        x = np.where(inside, word[np.minimum(a, n - 1)] ^ word[np.minimum(b, n - 1)], np.uint64(1 << 63))
        differs = x != 0
        d, xd = live[differs], x[differs]
        # whole equal bytes at the front of the word
        size[d] = step + sum((xd >> np.uint64(8 * k) == 0).astype(np.int64) for k in range(1, 8))
        live = live[~differs]
        step += 8
    found[at] = size
    start = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    out = np.maximum(found[start] - (np.arange(n) - start), 0)
    out[own] = found[own]
    return out


def repeated_windows(segments: list[bytes], counts: list[int]) -> list[np.ndarray]:
    """For each segment, which of its first ``counts`` places begin 400 bytes that also begin at another such place."""
    sizes = np.array([len(s) + 1 for s in segments], np.int64)
    buf = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)  # no UTF-8 text holds this byte
    begins = np.cumsum(sizes) - sizes
    order, word = suffix_array(buf)
    same = common_prefixes(order, word)[order] >= LENGTH
    inner = np.arange(len(buf)) - np.repeat(begins, sizes)
    window = inner < np.repeat(np.minimum(np.array(counts, np.int64), sizes - LENGTH), sizes)
    klass = np.cumsum(~same)
    here = window[order]
    many = np.bincount(klass[here], minlength=int(klass[-1]) + 1) > 1
    hit = np.zeros(len(buf), bool)
    hit[order] = here & many[klass]
    return [hit[b : b + c].copy() for b, c in zip(begins.tolist(), counts, strict=True)]


def may_repeat(segments: list[bytes], counts: list[int]) -> list[int]:
    """Which segments hold a window whose digest comes twice among all windows; no other can hold a repeat."""
    sizes = np.array([len(s) for s in segments], np.int64)
    full = np.minimum(np.array(counts, np.int64), np.maximum(sizes - LENGTH + 1, 0))
    owner = np.repeat(np.arange(len(segments)), full)
    places = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(np.cumsum(sizes) - sizes, full)
    d = _digests_at(np.frombuffer(b"".join(segments), np.uint8), places, LENGTH, 0)
    ordered = np.sort(d)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return []
    at = np.minimum(np.searchsorted(twice, d), len(twice) - 1)
    return np.unique(owner[twice[at] == d]).tolist()


def _digests_at(buf: np.ndarray, places: np.ndarray, lengths: np.ndarray | int, seed: int, part: int = 1 << 20) -> np.ndarray:
    """Hash of ``lengths`` bytes from each of ascending places on; the seed names one of independent functions."""
    out = np.empty(len(places), np.uint64)
    lengths = np.broadcast_to(lengths, places.shape)
    reach = int(lengths.max(initial=0))
    edges = np.searchsorted(places, np.arange(0, len(buf) + part, part))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if a < b:  # long buffers in overlapping parts, so that few powers are needed
            out[a:b] = _digests_of(buf[k * part : (k + 1) * part + reach], places[a:b] - k * part, lengths[a:b], int(_STEPS[seed]))
    return out


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    found = _POWERS.get(base)
    if found is None or len(found[0]) < n:
        size = max(1 << 13, n)
        found = _POWERS[base] = tuple(np.concatenate(([np.uint64(1)], np.full(size - 1, b, np.uint64))).cumprod(dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return found


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _digests_of(buf: np.ndarray, places: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    power, inverse = _powers(base, len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * power[: len(buf)], out=total[1:])
    return _mixed((total[places + lengths] - total[places]) * inverse[places])


def passages(segments: list[bytes], counts: list[int], worded: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which segment, place and length of every passage that begins at one of the first ``counts`` places.

    ``worded``: a segment begins where a word may begin. Passages cut by 400 bytes are left to the byte windows.
    """
    sizes = np.array([len(s) + 1 for s in segments], np.int64)
    buf = np.frombuffer(b"\xff".join(segments) + b"\xff", np.uint8)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    space = _SPACES[buf]
    before = np.concatenate(([True], space[:-1]))
    before[begins] = worded
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    owner = np.searchsorted(ends, start, side="right")
    start_ok = start - begins[owner] < np.array(counts, np.int64)[owner]
    start, owner = start[start_ok], owner[start_ok]
    if not len(start) or not len(end):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    k = np.searchsorted(end, start, side="right") + PASSAGE - 1
    size = np.maximum(end[np.minimum(k, len(end) - 1)] - start, SHORTEST)
    ok = (k < len(end)) & (size < LENGTH) & (start + size <= ends[owner] - 1)
    return owner[ok], start[ok] - begins[owner[ok]], size[ok]


def _passage_keys(segments: list[bytes], owner: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit digests as records."""
    begins = np.cumsum([0, *map(len, segments)])[:-1]
    raw = np.frombuffer(b"".join(segments), np.uint8)
    at = begins[owner] + place
    keys = np.empty(len(at), dtype=[("a", np.uint64), ("b", np.uint64)])
    keys["a"] = _digests_at(raw, at, size, 2) ^ size.astype(np.uint64)
    keys["b"] = _digests_at(raw, at, size, 3)
    return keys


def _often(keys: np.ndarray) -> np.ndarray:
    """Which keys come twice or more."""
    order = np.lexsort((keys["b"], keys["a"]))
    k = keys[order]
    same = (k["a"][1:] == k["a"][:-1]) & (k["b"][1:] == k["b"][:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:]] |= same
    out[order[:-1]] |= same
    return out


def merge_shards(shards: list[tuple[list[bytes], list[int]]], hits: list[list[np.ndarray]]) -> None:
    """Add to each shard's hits the windows that another shard has too."""
    sorted_shards = []
    for segments, counts in shards:
        raw = b"".join(segments)
        begins = np.cumsum([0, *map(len, segments)])[:-1]
        full = [min(c, max(0, len(s) - LENGTH + 1)) for s, c in zip(segments, counts, strict=True)]
        places = np.concatenate([b + np.arange(c) for b, c in zip(begins.tolist(), full, strict=True)])
        keys, sample, which = np.unique(_digests_at(np.frombuffer(raw, np.uint8), places, LENGTH, 4), return_index=True, return_inverse=True)
        sorted_shards.append((raw, keys, places[sample], which, np.zeros(len(keys), bool), full))
    for i, (raw, keys, places, _, twice, _) in enumerate(sorted_shards):
        for other, keys2, places2, _, twice2, _ in sorted_shards[:i]:
            if not len(keys) or not len(keys2):
                continue
            at = np.minimum(np.searchsorted(keys2, keys), len(keys2) - 1)
            for a in np.flatnonzero(keys2[at] == keys).tolist():
                b = int(at[a])
                if raw[places[a] : places[a] + LENGTH] == other[places2[b] : places2[b] + LENGTH]:
                    twice[a] = twice2[b] = True
    for own, (*_, which, twice, full) in zip(hits, sorted_shards, strict=True):
        for hit, more in zip(own, np.split(twice[which], np.cumsum(full)[:-1]), strict=True):
            hit[: len(more)] |= more


def _union(starts: np.ndarray, ends: np.ndarray) -> list[int]:
    """Covered bytes of ascending starts as flat start, end pairs."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    cut = np.flatnonzero(starts[1:] > reach[:-1])
    return np.stack((starts[np.concatenate(([0], cut + 1))], reach[np.concatenate((cut, [len(reach) - 1]))]), axis=1).reshape(-1).tolist()


def _shards(batches):
    """Rows (h, k1, k2, first, n, w, segment) sorted by h -> (k1, k2, runs, passes). An anchor's rows never part; memory is a shard's."""
    held: dict[tuple[int, bool, bytes], list[tuple[int, int, int]]] = {}
    size, last = 0, None

    def close():
        rows: tuple[list, list, list, list] = ([], [], [], [])
        keys = list(held)
        some = may_repeat([text for *_, text in keys], [n for n, *_ in keys])
        shards: list[tuple[list[bytes], list[int]]] = [([], [])]
        filled = 0
        for j in some:
            n, _, text = keys[j]
            if filled > SHARD and size > 2 * SHARD:
                shards.append(([], []))
                filled = 0
            shards[-1][0].append(text)
            shards[-1][1].append(n)
            filled += len(text) + 1
        parts = [repeated_windows(*x) for x in shards if x[0]]
        if len(shards) > 1:
            merge_shards(shards, parts)
        hits = dict(zip(some, (h for part in parts for h in part), strict=True))
        texts = [text for *_, text in keys]
        owner, place, length = passages(texts, [n for n, *_ in keys], [w for _, w, _ in keys])
        several = np.array([len(held[k]) > 1 for k in keys], bool)
        often = _often(_passage_keys(texts, owner, place, length)) | several[owner]
        owner, place, length = owner[often], place[often], length[often]
        bounds = np.searchsorted(owner, np.arange(len(keys) + 1))
        for j, k in enumerate(keys):
            if several[j]:  # equal segments: each repeats the others
                at = np.arange(min(k[0], len(k[2]) - LENGTH + 1))
            else:
                at = np.flatnonzero(hits[j]) if j in hits else np.zeros(0, np.int64)
            a, b = bounds[j], bounds[j + 1]
            if not len(at) and a == b:
                continue
            for k1, k2, first in held[k]:
                rows[0].append(k1)
                rows[1].append(k2)
                rows[2].append(_union(at + first, at + first + LENGTH))
                rows[3].append(_union(place[a:b] + first, place[a:b] + first + length[a:b]))
        held.clear()
        return _rows(*rows)

    for batch in batches:
        h, k1, k2, first, n, w = (batch.column(c).to_pylist() for c in range(6))
        for i, seg in enumerate(batch.column(6)):
            if h[i] != last and size >= SHARD:
                yield close()
                size = 0
            last = h[i]
            text = seg.as_py()
            owners = held.setdefault((n[i], w[i], text), [])
            if not owners:
                size += len(text) + 1
            owners.append((k1[i], k2[i], first[i]))
    if held:
        yield close()


def _rows(k1, k2, runs, passes):
    spans = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(runs, spans), pa.array(passes, spans)], names=["k1", "k2", "runs", "passes"])


def _distinct_texts(docs: DataFrame, text_column: str) -> DataFrame:
    """``k1, k2, text, times`` as a table bucketed by key in shared storage."""
    spark = docs.sparkSession
    text = text_or_empty(text_column)
    one = docs.select(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"))
    one = one.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("times"))
    name = f"vecdrift_texts_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/vecdrift/{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one.write.bucketBy(n, "k1", "k2").option("path", path).option("compression", "zstd").saveAsTable(name)
    delete_at_exit(spark, path)
    texts = spark.table(name)
    texts._vd_table = name, path
    return texts


def _drop_texts(texts: DataFrame) -> None:
    name, path = texts._vd_table
    spark = texts.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    delete_now(spark, path)


def _repeated(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Keys at two or more different (k1, k2, p) places, with how many rows name them."""
    place = F.xxhash64("k1", "k2", "p")
    found = rows.groupBy(*keys).agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("times")).where("a <> b")
    return materialize(found.select(*[F.col(k).alias(f"r_{k}") for k in keys], "times"), name)


def _batch(rows: list, types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, types, strict=True)], names=names)


def removed_runs(texts: DataFrame) -> DataFrame:
    """``k1, k2, runs, passes`` (arrays of flat start, end pairs; several rows a text) of distinct texts ``k1, k2, text``."""

    def find(batches):
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            who, h, at, *_ = anchors([t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(2)])
            yield _batch([h.view(np.int64), k1[who], k2[who], at], [pa.int64()] * 4, ["h", "k1", "k2", "p"])

    long = texts.where(F.octet_length("text") >= SHORTEST).select("k1", "k2", "text")
    found = materialize(long.mapInArrow(find, "h bigint, k1 bigint, k2 bigint, p bigint"), "anchors")
    again = _repeated(found, ["h"], "repeated-anchors")
    some_hot = not again.where(F.col("times") > HOT).isEmpty()
    marks = found.join(again, F.col("h") == F.col("r_h")).groupBy("k1", "k2").agg(F.collect_list(F.struct("p", (F.col("times") > HOT).alias("hot"))).alias("marks"))
    marked = long.join(marks.withColumnsRenamed({"k1": "m1", "k2": "m2"}), (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2"))).select("k1", "k2", "text", "marks")

    def chosen(batches, hot_ones):
        """(key 1, key 2, bytes, hash, first, last window) of every marked anchor of the wanted kind."""
        for batch in batches:
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            raws = [t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(2)]
            who, h, at, first, last, *_ = anchors(raws)
            order = np.argsort(who, kind="stable")
            bounds = np.searchsorted(who[order], np.arange(len(raws) + 1))
            h = h.view(np.int64)
            for i, raw in enumerate(raws):
                own = order[bounds[i] : bounds[i + 1]]
                wanted = sorted(m["p"] for m in batch.column(3)[i].as_py() if m["hot"] == hot_ones)
                found = own[np.searchsorted(at[own], wanted)] if wanted else own[:0]
                for x, a, b in zip(h[found].tolist(), first[found].tolist(), last[found].tolist(), strict=True):
                    yield k1[i], k2[i], raw, x, a, b

    def cut(batches):
        names = ["h", "k1", "k2", "p", "n", "w", "segment"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        rows: list[list] = [[] for _ in names]
        for k1, k2, raw, h, a, b in chosen(batches, False):
            for x, v in zip(rows, (h, k1, k2, a, b - a + 1, not a or bool(_SPACES[raw[a - 1]]), raw[a : b + LENGTH]), strict=True):
                x.append(v)
            if len(rows[0]) >= 4096:
                yield _batch(rows, types, names)
                rows = [[] for _ in names]
        yield _batch(rows, types, names)

    def digests(batches):
        names = ["d1", "d2", "k1", "k2", "p", "n"]
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def batch():
            return _batch([np.concatenate(x) for x in zip(*held, strict=True)] if held else [[]] * 6, [pa.int64()] * 6, names)

        for k1, k2, raw, _, a, b in chosen(batches, True):
            _, place, length = passages([raw[a : b + LENGTH]], [b - a + 1], [not a or bool(_SPACES[raw[a - 1]])])
            full = np.arange(a, min(b, len(raw) - LENGTH) + 1)
            at, n = np.concatenate((full, place + a)), np.concatenate((np.full(len(full), LENGTH), length))
            d = np.frombuffer(b"".join(hashlib.blake2b(raw[j : j + m], digest_size=16).digest() for j, m in zip(at.tolist(), n.tolist(), strict=True)), np.int64).reshape(-1, 2)
            held.append((d[:, 0], d[:, 1], np.full(len(at), k1), np.full(len(at), k2), at, n))
            size += len(at)
            if size >= 1 << 15:  # a few MB
                yield batch()
                held, size = [], 0
        yield batch()

    some = lambda hot_ones: marked.where(F.exists("marks", lambda m: m["hot"] == F.lit(hot_ones)))
    dealt = some(False).mapInArrow(cut, "h bigint, k1 bigint, k2 bigint, p bigint, n int, w boolean, segment binary")
    dealt = dealt.repartition("h").sortWithinPartitions("h").mapInArrow(_shards, "k1 bigint, k2 bigint, runs array<bigint>, passes array<bigint>")
    if not some_hot:
        return dealt
    windows = materialize(some(True).mapInArrow(digests, "d1 bigint, d2 bigint, k1 bigint, k2 bigint, p bigint, n bigint"), "hot-windows")
    twice = _repeated(windows, ["d1", "d2"], "repeated-windows")
    span, none = F.array("p", F.col("p") + F.col("n")), F.array().cast("array<bigint>")
    of_hot = windows.join(twice, (F.col("d1") == F.col("r_d1")) & (F.col("d2") == F.col("r_d2")))
    of_hot = of_hot.select("k1", "k2", F.when(F.col("n") == LENGTH, span).otherwise(none).alias("runs"), F.when(F.col("n") < LENGTH, span).otherwise(none).alias("passes"))
    return dealt.unionByName(of_hot)


def _merged(runs: list[list[int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r[i], r[i + 1]) for r in runs for i in range(0, len(r), 2)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_bytes: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_bytes`` a row; ``with_bytes`` adds ``kept`` (binary).

    ``n_passages``: maximal runs covered by repeated passages or by what is removed; ``n_passage_bytes``: their bytes.
    """
    text = text_or_empty(text_column)
    texts = _distinct_texts(docs, text_column)
    runs = removed_runs(texts).groupBy("k1", "k2").agg(F.collect_list("runs").alias("runs"), F.collect_list("passes").alias("passes")).withColumnsRenamed({"k1": "m1", "k2": "m2"})
    j = texts.join(runs, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left").select("k1", "k2", "text", "times", "runs", "passes")
    names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_bytes"] + ["kept"] * with_bytes

    def finish(batches):
        for batch in batches:
            times = batch.column(3).to_pylist()
            rows: tuple[list, ...] = tuple([] for _ in names[2:])
            for i, (t, r, q) in enumerate(zip(batch.column(2), batch.column(4), batch.column(5), strict=True)):
                raw = t.as_py().encode("utf-8", "surrogatepass")
                many = times[i] > 1
                whole = many and len(raw) >= LENGTH
                cut = [(0, len(raw))] if whole else _merged(r.as_py() or []) if r.is_valid else []
                own = q.as_py() if q.is_valid else []
                if many and SHORTEST <= len(raw) < LENGTH:
                    _, at, size = passages([raw], [len(raw) - SHORTEST + 1], [True])
                    own = [_union(at, at + size)]
                found = _merged([*own, *([a, b] for a, b in cut)])
                kept = kept_bytes(raw, cut)
                total = lambda spans: sum(b - a for a, b in spans)
                for x, v in zip(rows, (len(raw), total(cut), len(cut), hashlib.sha256(kept).hexdigest(), len(found), total(found), kept), strict=False):
                    x.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, y) for x, y in zip(rows, types, strict=False))], names=names)

    done = j.mapInArrow(finish, "k1 bigint, k2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passages bigint, n_passage_bytes bigint" + ", kept binary" * with_bytes)
    done = materialize(done, "deduped").withColumnsRenamed({"k1": "m1", "k2": "m2"})
    _drop_texts(texts)  # nothing reads them any more
    own = docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    return own.join(done, (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2"))).select("doc_id", *names[2:])


def digest(docs: DataFrame) -> DataFrame:
    return dedup(docs)


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str, int, int]]:
    """By dictionaries of all strings of that length and of all passages, for tests."""
    import re
    from collections import Counter

    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    each = []
    for r in raws:
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", r)]
        own = [(a, max(words[j + PASSAGE - 1][1] - a, SHORTEST)) for j, (a, _) in enumerate(words[: max(0, len(words) - PASSAGE + 1)])]
        each.append([(a, n) for a, n in own if n < length and a + n <= len(r)])
    told = Counter(r[a : a + n] for r, own in zip(raws, each, strict=True) for a, n in own)
    out = []
    for r, own in zip(raws, each, strict=True):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        found = gone.copy()
        for a, n in own:
            if told[r[a : a + n]] > 1:
                found[a : a + n] = True
        spans = lambda x: int((np.diff(np.concatenate(([0], x.astype(np.int8)))) == 1).sum())
        out.append((len(r), int(gone.sum()), spans(gone), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~gone])).hexdigest(), spans(found), int(found.sum())))
    return out


#: Every window of every text by its md5, then islands of repeated ones; passages likewise, by the words' places.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT r, p, md5(substr(h, 2 * p + 1, 800)) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM d WHERE length(h) >= 800)
), x AS (
  SELECT r, p FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)
), i AS (
  SELECT r, p, sum(CASE WHEN q IS NULL OR p - q > 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS g
  FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM x)
), s AS (
  SELECT r, min(p) AS a, max(p) + 400 AS b FROM i GROUP BY r, g
), l AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS c FROM s
), k AS (
  SELECT l.r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS e, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS kept
  FROM l JOIN d ON d.r = l.r GROUP BY l.r
), c1 AS (
  SELECT r, p, substr(h, 2 * p + 1, 2) IN ('20', '09', '0A', '0B', '0C', '0D') AS space
  FROM (SELECT r, h, unnest(range(0, length(h) // 2)) AS p FROM d WHERE length(h) >= 512)
), c2 AS (
  SELECT r, p, space, coalesce(lag(space) OVER t, true) AS before, coalesce(lead(space) OVER t, true) AS behind FROM c1 WINDOW t AS (PARTITION BY r ORDER BY p)
), b1 AS (
  SELECT r, p AS a, row_number() OVER (PARTITION BY r ORDER BY p) AS j FROM c2 WHERE NOT space AND before
), b2 AS (
  SELECT r, p + 1 AS b, row_number() OVER (PARTITION BY r ORDER BY p) AS j FROM c2 WHERE NOT space AND behind
), v AS (
  SELECT b1.r, a, greatest(b - a, 256) AS n FROM b1 JOIN b2 ON b1.r = b2.r AND b1.j + 50 = b2.j
), v2 AS (
  SELECT v.r, a, n, md5(substr(h, 2 * a + 1, 2 * n)) AS m FROM v JOIN d ON d.r = v.r WHERE n < 400 AND a + n <= length(h) // 2
), f AS (
  SELECT r, a, a + n AS b FROM v2 WHERE m IN (SELECT m FROM v2 GROUP BY m HAVING count(*) > 1) UNION ALL SELECT r, a, b FROM s
), f2 AS (
  SELECT r, a, b, max(b) OVER (PARTITION BY r ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM f
), f3 AS (
  SELECT r, a, b, sum(CASE WHEN q IS NULL OR a > q THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY a, b) AS g FROM f2
), f4 AS (
  SELECT r, count(*) AS n_passages, sum(b - a) AS n_passage_bytes FROM (SELECT r, min(a) AS a, max(b) AS b FROM f3 GROUP BY r, g) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * e + 1), h))) AS kept_sha256,
       CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages, CAST(coalesce(n_passage_bytes, 0) AS BIGINT) AS n_passage_bytes
FROM d LEFT JOIN k ON d.r = k.r LEFT JOIN f4 ON d.r = f4.r
"""
