r"""Token-ID output as Re-Pair grammar-compressed blocks (operator 8).

Documents are range-partitioned by id and sorted, so partition, block and place are ascending. Each task encodes its
texts with the tokenizers library, appends the end id, and cuts its stream into blocks of at least ``BLOCK`` ids at
document ends. A block is compressed by Re-Pair: round by round the pairs of neighbouring symbols are counted over the
whole block, the frequent ones become nonterminals, and their occurrences (left to right, none across a document end)
are replaced, until no pair is frequent enough. Stored are the rules, the length of each rule's expansion, the
sequence, and where each document begins in it, so one document is decoded without its neighbours.

A block is one row ``(shard, block, n_docs, n_tokens, payload)`` of a Parquet dataset in shared storage: Spark's
committer makes a retried task harmless. ``payload`` (little-endian) is

    magic "VDRP", version u32, n_docs u32, n_rules u32, n_symbols u32, first_nonterminal u32
    doc ids i64[n_docs], null marks u8[n_docs], begins in the sequence u32[n_docs + 1], id counts u32[n_docs]
    rules u32[n_rules, 2], expansion lengths u32[n_rules], sequence u32[n_symbols]

Defined results: null or empty texts are the end id alone; a null doc_id sorts first; repeated rows follow each other,
ordered by content hash; an empty table gives no blocks. A string in a text that spells an added token such as
<|endoftext|> becomes that token, as the library has it. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

END_ID = 0
BLOCK = 1 << 20
LEAST_COUNT = 16
RULES_A_ROUND = 4096
_SLOT_BITS = 21
_CACHE_PIECES, _CACHE_IDS = 1 << 20, 4 << 20
_LONG = 64


def _bytes_where(test) -> np.ndarray:
    return np.array([test(c) for c in range(256)], bool)


_LETTER = _bytes_where(lambda c: 65 <= c <= 90 or 97 <= c <= 122)
_PRINTED = _bytes_where(lambda c: 33 <= c <= 126)
#: First bytes of characters that are no white space: printed ASCII and leads of sequences without spaces in their range.
_SOLID = _bytes_where(lambda c: 33 <= c <= 126 or 0xC3 <= c <= 0xE0 or 0xE4 <= c <= 0xF4)
_PAUSE = _bytes_where(lambda c: c in b",.")
#: Second bytes of Latin-1's letters in UTF-8; the first is 0xC3.
_LATIN = _bytes_where(lambda c: 0x80 <= c <= 0xBF and c not in (0x97, 0xB7))
#: Of eight bytes, the first 0 to 8.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _spelling() -> np.ndarray:
    """The character that byte-level tokenizers write for a byte, here with a space for the line feed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = np.zeros(256, "<u4")
    out[plain] = plain
    out[out == 0] = np.arange(256, 256 + 256 - len(plain))
    out[10] = 32
    return out


_SPELLING = _spelling()


def _eights(raw: bytes, starts: np.ndarray, lengths: np.ndarray, of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """j, those pieces of ``of`` that have a j-th eight bytes, and these as one number, zeros after the piece's end."""
    a = np.frombuffer(raw + bytes(-len(raw) % 8 + 8), "<u8")
    j = 0
    while len(of):
        at = starts[of] + 8 * j
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        w = a[place] >> shift | a[place + 1] << np.uint64(1) << (np.uint64(63) - shift)
        left = lengths[of] - 8 * j
        w &= _FIRST[np.minimum(left, 8)]
        yield j, of, w
        of, j = of[left > 8], j + 1


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of this Python worker: tasks that follow each other share its cache."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Pieces:
    """Hash -> place, open addressing in numpy arrays that double before they fill; keys are never 0."""

    def __init__(self):
        self.bits = _SLOT_BITS
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.places = np.zeros(1 << self.bits, np.int32)
        self.n = 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places, -1 where absent. Keys differ from each other."""
        out = np.full(len(h), -1, np.int64)
        live, slot = np.arange(len(h)), self._slots(h)
        while len(live):
            k = self.keys[slot]
            same = k == h[live]
            out[live[same]] = self.places[slot[same]]
            go = ~same & (k != 0)
            live, slot = live[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray) -> None:
        """New keys get the next places, in order."""
        self._widen(self.n + len(h))
        self._put(h, np.arange(self.n, self.n + len(h)))
        self.n += len(h)

    def _widen(self, n: int) -> None:
        """So many slots that ``n`` keys fill three quarters at most: a full table would be searched without end."""
        if 4 * n <= 3 << self.bits:
            return
        used = np.flatnonzero(self.keys)
        keys, places = self.keys[used], self.places[used]
        while 4 * n > 3 << self.bits:
            self.bits += 1
        self.keys, self.places = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self._put(keys, places)

    def _put(self, h: np.ndarray, places: np.ndarray) -> None:
        live, slot = np.arange(len(h)), self._slots(h)
        while len(live):
            free = np.flatnonzero(self.keys[slot] == 0)
            one, first = np.unique(slot[free], return_index=True)  # one key a free slot
            who = live[free[first]]
            self.keys[one], self.places[one] = h[who], places[who]
            stay = np.ones(len(live), bool)
            stay[free[first]] = False
            live, slot = live[stay], (slot[stay] + 1) & ((1 << self.bits) - 1)


class Encoder:
    """Exact encoding with a cache of pieces.

    Byte-level BPE splits a text first and never merges across the splits. Some are certain from the bytes alone: before
    a space that something solid follows, between an ASCII letter and a comma or full stop, and between a line feed
    after printed ASCII and a letter. Texts are cut there in numpy, pieces are known by a 64-bit hash (long ones by a
    digest), and each new piece is encoded once - those that begin with a space all in one text, which the tokenizer
    splits between them again; the tokens' byte lengths tell where. Pieces that are one word go without the library's
    splitting, by the same model. The cache keeps the pieces' bytes, and what is looked up is compared with the text, eight
    bytes at a time, so a clash of hashes costs time, never a wrong id.

    Texts that hold one of the tokenizer's added tokens, and all texts if it isn't byte-level BPE with the usual
    splitting and no normalizer, are encoded whole by the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # what it gets is spelt in byte-level characters
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts_hold = self._splits_as_known(json.loads(self.tokenizer.to_str()))
        # byte-level tokens are written with one character a byte
        self.bytes_of = np.zeros(self.vocabulary, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes_of[i] = len(token)
        self._reset()

    @staticmethod
    def _splits_as_known(stated: dict) -> bool:
        before = stated.get("pre_tokenizer") or {}
        usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        return bool(usual and stated.get("normalizer") is None and stated["model"].get("type") == "BPE" and not stated["model"].get("ignore_merges"))

    def plain(self, texts: list[str]) -> list[list[int]]:
        """Ids by the library alone, without end ids."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _reset(self) -> None:
        self.pieces = Pieces()
        self.ids, self.begins, self.n_ids = np.zeros(1 << 18, np.uint32), np.zeros((1 << 16) + 1, np.int64), 0
        # the pieces' bytes, eight a number, each piece from a new one on; begins there, and lengths in bytes
        self.letters, self.n_letters = np.zeros(1 << 17, np.uint64), 0
        self.letter_begins, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _add(self, keys: np.ndarray, raw: bytes, starts: np.ndarray, size: np.ndarray) -> None:
        upto = np.cumsum(size)
        begins = upto - size
        b = np.frombuffer(raw, np.uint8)[np.repeat(starts - begins, size) + np.arange(upto[-1])]
        # a single pretoken for certain: ASCII and Latin-1 letters after at most one space
        latin = (b[:-1] == 0xC3) & _LATIN[b[1:]]
        solid = _LETTER[b]
        solid[:-1] |= latin
        solid[1:] |= latin
        spaced = b[begins] == 32
        solid[begins] |= spaced & (size > 1)
        word = np.logical_and.reduceat(solid, begins)
        alone, spaced, others = np.flatnonzero(~word & ~spaced), np.flatnonzero(~word & spaced), lambda x: [raw[a : a + n] for a, n in zip(starts[x].tolist(), size[x].tolist(), strict=True)]
        own = [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in others(alone)], add_special_tokens=False)]
        found = [np.fromiter(chain.from_iterable(own), np.uint32)]
        counts = [np.fromiter(map(len, own), np.int64, len(own))]
        for at in range(0, len(spaced), 1 << 14):
            some = spaced[at : at + (1 << 14)]
            self._append(found, counts, self.tokenizer, b"".join(others(some)).decode(), size[some])
        spelt = np.full(int(size[word].sum() + word.sum()), 32, "<u4")
        spelt[np.arange(size[word].sum()) + np.repeat(np.arange(word.sum()), size[word])] = _SPELLING[b[np.repeat(word, size)]]
        word = np.flatnonzero(word)
        ends = np.concatenate(([0], np.cumsum(size[word] + 1)))
        for at in range(0, len(word), 1 << 10):
            some = word[at : at + (1 << 10)]
            self._append(found, counts, self.words, spelt[ends[at] : ends[at + len(some)]].tobytes().decode("utf-32-le"), size[some])
        ids, n = np.concatenate(found), np.concatenate(counts)
        first = self.pieces.n
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while first + len(n) + 1 > len(self.begins):
            self.begins = np.concatenate((self.begins, np.zeros_like(self.begins)))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.begins[first + 1 : first + len(n) + 1] = self.n_ids + np.cumsum(n)
        self.n_ids += len(ids)
        in_order = np.concatenate((alone, spaced, word))
        n_eights = -(-size[in_order] // 8)
        at = np.empty(len(size), np.int64)
        at[in_order] = np.cumsum(n_eights) - n_eights
        letters = np.zeros(8 * int(n_eights.sum()), np.uint8)
        letters[np.repeat(8 * at - begins, size) + np.arange(len(b))] = b
        letters = letters.view("<u8")
        while self.n_letters + len(letters) > len(self.letters):
            self.letters = np.concatenate((self.letters, np.zeros_like(self.letters)))
        while first + len(n) > len(self.lengths):
            self.letter_begins, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.letter_begins, self.lengths))
        self.letters[self.n_letters : self.n_letters + len(letters)] = letters
        self.letter_begins[first : first + len(n)] = self.n_letters + at[in_order]
        self.lengths[first : first + len(n)] = size[in_order]
        self.n_letters += len(letters)
        self.pieces.add(keys[in_order])

    def _append(self, found: list, counts: list, by, text: str, size: np.ndarray) -> None:
        """Ids of pieces of so many bytes, encoded in one text, and how many ids each has."""
        ids = np.array(by.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        upto = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(size), side="right")
        found.append(ids)
        counts.append(np.diff(np.concatenate(([0], upto))))

    def _spelt(self, at: np.ndarray, raw: bytes, starts: np.ndarray, lengths: np.ndarray, eights: list, long: list[int]) -> bool:
        """Whether the pieces of the text are those known at the places ``at``."""
        begins = self.letter_begins[at]
        if (self.lengths[at] != lengths).any() or any((self.letters[begins[of] + j] != w).any() for j, of, w in eights):
            return False
        return all(self.letters[b : b + -(-n // 8)].tobytes()[:n] == raw[s : s + n] for b, s, n in zip(begins[long].tolist(), starts[long].tolist(), lengths[long].tolist(), strict=True))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the id count of each."""
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        whole = [not self.cuts_hold or any(a in r for a in self.added) for r in raws]
        if not any(whole):
            return self._encode(texts, raws)
        rest = [i for i, w in enumerate(whole) if not w]
        found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        if rest:
            ids, counts = self._encode([texts[i] for i in rest], [raws[i] for i in rest])
            found_rest = np.split(ids, np.cumsum(counts)[:-1])
            for i, x in zip(rest, found_rest, strict=True):
                found[i] = x
        some = [i for i, w in enumerate(whole) if w]
        for i, x in zip(some, self.plain([texts[i] for i in some]), strict=True):
            found[i] = np.array([*x, END_ID], np.uint32)
        return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))

    def _encode(self, texts: list[str], raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.pieces.n > _CACHE_PIECES or self.n_ids > _CACHE_IDS:
            self._reset()
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        doc_ends = np.cumsum(sizes)
        raw = b"".join(raws)
        if not raw:
            return np.full(len(texts), END_ID, np.uint32), np.ones(len(texts), np.int64)
        buf = np.frombuffer(raw, np.uint8)
        n = len(buf)
        cut = np.zeros(n + 1, bool)
        cut[: n - 1] = (buf[:-1] == 32) & _SOLID[buf[1:]]
        letter = _LETTER[buf]
        cut[1:n] |= letter[:-1] & _PAUSE[buf[1:]]
        cut[2:n] |= _PRINTED[buf[:-2]] & (buf[1:-1] == 10) & letter[2:]
        cut[0] = cut[n] = True
        cut[doc_ends] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        lengths = ends - starts
        long = np.flatnonzero(lengths > _LONG).tolist()
        h = lengths.astype(np.uint64)
        eights = list(_eights(raw, starts, lengths, np.flatnonzero(lengths <= _LONG) if long else np.arange(len(starts))))
        for _, of, w in eights:
            x = (h[of] ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h[of] = x ^ x >> np.uint64(32)
        for i in long:
            h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8).digest(), "little")
        h[h == 0] = 1
        order = np.argsort(h)
        ordered = h[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        keys, sample = ordered[new], order[new]
        place = self.pieces.find(keys)
        absent = np.flatnonzero(place < 0)
        if len(absent):
            k = sample[absent]
            self._add(keys[absent], raw, starts[k], lengths[k])
            place[absent] = self.pieces.find(keys[absent])
        at = place[which]
        if not self._spelt(at, raw, starts, lengths, eights, long):
            own = self.plain(texts)  # two pieces of one hash
            return np.array([i for x in own for i in (*x, END_ID)], np.uint32), np.fromiter(map(len, own), np.int64, len(own)) + 1
        first = self.begins[at]
        n_ids = self.begins[at + 1] - first
        upto = np.concatenate(([0], np.cumsum(n_ids)))
        ids = self.ids[np.repeat(first - upto[:-1], n_ids) + np.arange(upto[-1])]
        ends_at = upto[np.searchsorted(starts, doc_ends)]
        return np.insert(ids, ends_at, np.uint32(END_ID)), np.diff(np.concatenate(([0], ends_at))) + 1


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int, least: int = LEAST_COUNT, a_round: int = RULES_A_ROUND) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``ids`` cut at ``ends`` (cumulative counts) -> rules [n, 2], sequence, the documents' ends in the sequence."""
    seq = ids.astype(np.int64)
    rules: list[np.ndarray] = []
    n = vocabulary
    while len(seq) > 1:
        codes = seq[:-1] << 32
        codes |= seq[1:]
        across = ends[ends < len(seq)] - 1
        codes[across] = -1
        codes.sort()
        ordered = codes[codes.searchsorted(0) :]
        if not len(ordered):
            break
        edges = np.concatenate(([0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, [len(ordered)]))
        counts = np.diff(edges)
        often = np.flatnonzero(counts >= least)
        if len(often) > a_round:
            often = often[np.argsort(-counts[often], kind="stable")[:a_round]]
        if not len(often):
            break
        pairs = np.sort(ordered[edges[often]])
        # which pair stands at a place: a grid of the distinct left and right symbols, 0 where no pair is
        left, right = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        rows, columns = np.unique(left), np.unique(right)
        row, column = np.zeros(n, np.int64), np.zeros(n, np.int64)
        row[rows] = np.arange(1, len(rows) + 1) * (len(columns) + 1)
        column[columns] = np.arange(1, len(columns) + 1)
        grid = np.zeros((len(rows) + 1) * (len(columns) + 1), np.int16 if len(pairs) < 1 << 15 else np.int32)
        grid[row[left] + column[right]] = np.arange(1, len(pairs) + 1)
        cell = row[seq[:-1]]
        cell += column[seq[1:]]
        found = grid[cell]
        found[across] = 0
        maybe = np.flatnonzero(found)
        # of overlapping occurrences the first, third, ... are taken
        follow = np.flatnonzero(maybe[1:] - maybe[:-1] == 1) + 1
        if len(follow):
            place = np.arange(len(follow))
            since = place - np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(follow) != 1)), place, 0))
            taken = np.ones(len(maybe), bool)
            taken[follow[since % 2 == 0]] = False
            maybe = maybe[taken]
        which = found[maybe] - 1
        hit = np.bincount(which, minlength=len(pairs)) > 0
        used = np.flatnonzero(hit)
        seq[maybe] = (n - 1 + np.cumsum(hit))[which]
        stay = np.ones(len(seq), bool)
        stay[maybe + 1] = False
        before = len(seq)
        seq, ends = seq[stay], ends - np.searchsorted(maybe + 1, ends)
        rules.append(np.stack((pairs[used] >> 32, pairs[used] & 0xFFFFFFFF), axis=1))
        n += len(used)
        if before - len(seq) < before // 64:  # what a round still saves is less than its rules and time are worth
            break
    return (np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)), seq, ends


def expansion_lengths(rules: np.ndarray, vocabulary: int) -> np.ndarray:
    lengths = np.ones(vocabulary + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        lengths[vocabulary + k] = lengths[a] + lengths[b]
    return lengths[vocabulary:]


def expand(seq: np.ndarray, rules: np.ndarray, vocabulary: int) -> np.ndarray:
    """Rules refer to earlier symbols only, so replacing all nonterminals again and again ends."""
    seq = seq.astype(np.int64)
    while len(big := np.flatnonzero(seq >= vocabulary)):
        pair = rules[seq[big] - vocabulary]
        seq = np.insert(seq, big + 1, pair[:, 1])
        seq[big + np.arange(len(big))] = pair[:, 0]
    return seq.astype(np.uint32)


def expand_all(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """As ``expand``, for a whole block: each rule is expanded once, then all symbols are copied in one go."""
    whole: list[tuple[int, ...]] = []
    for a, b in rules.tolist():
        whole.append((whole[a - vocabulary] if a >= vocabulary else (a,)) + (whole[b - vocabulary] if b >= vocabulary else (b,)))
    spelt = np.concatenate((np.arange(vocabulary, dtype=np.uint32), np.fromiter(chain.from_iterable(whole), np.uint32)))
    size = np.concatenate((np.ones(vocabulary, np.int64), lengths.astype(np.int64)))
    begin = np.cumsum(size) - size
    n = size[seq]
    return spelt[np.repeat(begin[seq] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def pack(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, vocabulary: int) -> bytes:
    rules, seq, ends = compress(ids, np.cumsum(counts), vocabulary)
    head = struct.pack("<4s5I", b"VDRP", 1, len(doc_ids), len(rules), len(seq), vocabulary)
    begins = np.concatenate(([0], ends))
    u4 = lambda x: np.ascontiguousarray(x, dtype="<u4").tobytes()
    return b"".join([head, doc_ids.astype("<i8").tobytes(), nulls.astype(np.uint8).tobytes(), u4(begins), u4(counts), u4(rules), u4(expansion_lengths(rules, vocabulary)), u4(seq)])


class Block:
    def __init__(self, payload: bytes):
        magic, version, n, n_rules, n_symbols, self.vocabulary = struct.unpack_from("<4s5I", payload)
        if magic != b"VDRP" or version != 1:
            raise ValueError("not a block of this format")
        at = 24

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls = take("<i8", n), take("u1", n)
        self.begins, self.counts = take("<u4", n + 1), take("<u4", n)
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2).astype(np.int64)
        self.lengths, self.seq = take("<u4", n_rules), take("<u4", n_symbols)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document alone, with its end id."""
        return expand(self.seq[self.begins[k] : self.begins[k + 1]], self.rules, self.vocabulary)

    def at(self, k: int, i: int) -> int:
        """The i-th id of the k-th document, without expanding it: down the rules by expansion lengths."""
        size = lambda x: 1 if x < self.vocabulary else int(self.lengths[x - self.vocabulary])
        seq = self.seq[self.begins[k] : self.begins[k + 1]].astype(np.int64)
        big = np.minimum(np.maximum(seq - self.vocabulary, 0), max(0, len(self.lengths) - 1))
        sizes = np.where(seq < self.vocabulary, 1, self.lengths[big] if len(self.lengths) else 1).astype(np.int64)
        upto = np.cumsum(sizes)
        j = int(np.searchsorted(upto, i, side="right"))
        i, x = i - int(upto[j] - sizes[j]), int(seq[j])
        while x >= self.vocabulary:
            a, b = self.rules[x - self.vocabulary].tolist()
            x, i = (a, i) if i < size(a) else (b, i - size(a))
        return x

    def documents(self) -> Iterator[np.ndarray]:
        ids = expand_all(self.seq, self.rules, self.lengths, self.vocabulary)
        at = 0
        for n in self.counts.tolist():
            yield ids[at : at + n]
            at += n


#: Bytes of stored input a shard; what the planner knows of the input's size sets the number of shards.
SHARD_BYTES = 32 << 20


def _shards_of(docs: DataFrame) -> int:
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(least, -(-size // SHARD_BYTES)), max(least, 1 << 16))


_BLOCKS = "shard int, block int, n_docs bigint, n_tokens bigint, payload binary"


def encode(docs: DataFrame, tokenizer_path: str | None = None, id_column: str = "doc_id", text_column: str = "text", block: int = BLOCK) -> DataFrame:
    """The blocks of ``docs``, lazily; write them with any Spark writer."""
    path = tokenizer_path or default_tokenizer()
    df = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_or_empty(text_column).alias("t")).withColumn("h", F.xxhash64("t"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]

    def run(batches):
        from pyspark import TaskContext

        encoder, shard, number = encoder_of(path), TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        owners: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def close():
            nonlocal number, held
            o, z, c = (np.concatenate([x[0] for x in owners]), np.concatenate([x[1] for x in owners]), np.concatenate(counts))
            payload = pack(o, z, c, np.concatenate(ids), encoder.vocabulary)
            row = [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(o)], pa.int64()), pa.array([int(c.sum())], pa.int64()), pa.array([payload], pa.binary())]
            number += 1
            held = 0
            for x in (ids, counts, owners):
                x.clear()
            return pa.RecordBatch.from_arrays(row, names=["shard", "block", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            who = batch.column(0)
            texts = batch.column(1)
            at = 0
            while at < batch.num_rows:
                few, size = [], 0
                while at + len(few) < batch.num_rows and size < 1 << 20:
                    few.append(texts[at + len(few)].as_py())
                    size += len(few[-1])
                got, n = encoder.encode(few)
                own = who.slice(at, len(few))
                ids.append(got)
                counts.append(n)
                owners.append((own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)))
                held += len(got)
                at += len(few)
                if held >= block:
                    yield close()
        if held:
            yield close()

    return df.repartitionByRange(_shards_of(docs), *order).sortWithinPartitions(*order).select("doc_id", "t").mapInArrow(run, _BLOCKS)


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, **columns) -> None:
    encode(docs, tokenizer_path, **columns).write.parquet(path)


def _placed(blocks: DataFrame) -> DataFrame:
    """Adds ``first``: ids in all blocks before. Prefix sums over shards, then inside a shard: no task gets all blocks.

    The sums, three numbers a block, go to the blocks as a broadcast: payloads are not shuffled for them.
    """
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("s"))
    shards = shards.select(F.col("shard").alias("sh"), (F.sum("s").over(Window.orderBy("shard")) - F.col("s")).alias("shard_first"))
    inside = blocks.select("shard", "block", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("inner_first"))
    placed = inside.join(shards, F.col("shard") == F.col("sh")).select(F.col("shard").alias("s2"), F.col("block").alias("b2"), (F.col("shard_first") + F.col("inner_first")).alias("first"))
    return blocks.join(F.broadcast(placed), (F.col("shard") == F.col("s2")) & (F.col("block") == F.col("b2")))


def read(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in written blocks, from the decoded ids."""

    def run(batches):
        for batch in batches:
            for payload, first in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                b = Block(payload.as_py())
                n = b.counts.astype(np.int64)
                crc = np.fromiter((zlib.crc32(x.astype("<u4").tobytes()) for x in b.documents()), np.int64, len(n))
                ids = pa.array(b.doc_ids, mask=b.nulls.astype(bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(first + np.cumsum(n) - n), pa.array(n), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(blocks).select("payload", F.col("first").cast("long").alias("first")).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def decode(blocks: DataFrame) -> DataFrame:
    """``doc_id, ids`` (array<int>, with the end id)."""

    def run(batches):
        for batch in batches:
            for payload in batch.column(0):
                b = Block(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(b.doc_ids, mask=b.nulls.astype(bool)), pa.array([x.astype(np.int32) for x in b.documents()], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return blocks.select("payload").mapInArrow(run, "doc_id bigint, ids array<int>")


def digest(docs: DataFrame) -> DataFrame:
    return read(materialize(encode(docs), "tokens"))
