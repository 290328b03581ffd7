"""Language-model scores from a sharded Elias-Fano bigram trie.

Counting: one pass counts the training words (hashes, pre-aggregated per task).
A second pass sends every token pair (context, word) of every document, packed
per task and shard, to the shard that owns its context. A context with more pairs than
half a shard is split over shards by classes of the following word, into as many parts as
its count needs. These contexts, and words above a share of ``1 / COMMON``, are broadcast with
their counts: there are at most ``MOST_SPLIT``, since below a share of ``1 / MOST_SPLIT`` of
all tokens none is split (at 10^13 tokens such a context has five shards' worth of pairs).

Trie: a shard counts the training pairs it received and lays them out as levels of
one memory-mapped buffer: contexts, words and the monotone pointers from a context to its
successors as Elias-Fano sequences; successors as one Elias-Fano sequence of
``context rank * words + word rank``; probabilities and back-off weights as one-byte
codes. A look-up finds the context, takes the range of its successors from the pointers
and searches the word inside that range only. Levels stay packed: positions of bits are
found through a directory of one count for 64 bits. The map is anonymous, since a task has
no folder that outlives it or that others could read; ``open`` maps a written trie.

Smoothing: absolute discounting. A seen pair has (count - D) / count(context). The
mass kept back goes to unseen words in proportion to their add-one unigram
probability, divided by the share that is surely unseen (frequent words seen after the
context are left out), so a context's probabilities sum to at most 1. Unigram
look-ups of unseen pairs are a join with the word counts.

Scores of a document are sums over shards. Nothing of the corpus passes through the
driver but totals, at most ``MOST_SPLIT`` frequent words and the masses of ``MOST_CLASSES``
classes of words at most.

Null texts count as empty and have the end token only. A null id counts as the
empty text in the fold rule. Repeated ids are separate rows. With no training rows
all counts are zero and every word is unknown. An empty table gives an empty result.
"""

from __future__ import annotations

import io
import math
import mmap
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_type, id_remainder, utf8
from quillspark.operators.durable import durable

END = b"\n"  # no word has white space
COMMON = 2000
MOST_SPLIT = 1_000_000
MOST_CLASSES = 1 << 20
CHUNK_BYTES = 12 << 20
CHUNK_DOCS = 60_000
PIECE_WORDS = 2_000_000
TOKENS_PER_SHARD = 2_000_000
DISCOUNT = 0.75


def lm_words(text: bytes) -> list[bytes]:
    return text.lower().split()


class Numbering(dict):
    """Numbers words from 0 in the order they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def word_hashes(words: list[bytes] | dict) -> np.ndarray:
    """64-bit hashes of which the lowest byte is dropped; 56 bits remain, as non-negative longs."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, words), np.uint64, len(words)) >> np.uint64(8)


END_HASH = int(word_hashes([END])[0])


# ---------------------------------------------------------------- Elias-Fano levels


_BIT_OF_BYTE = np.array([[next((k for k in range(8) if bin(b & ((2 << k) - 1)).count("1") == r + 1), 8) for r in range(8)] for b in range(256)], dtype=np.uint8)
STEP = 1 << 17  # positions that are looked up at a time


class EliasFano:
    """A monotone sequence in about ``2 + log2(universe / n)`` bits per value, with successor search.

    Upper parts are marked in unary in ``high`` (a one for each value after a zero for
    each step of the upper part), lower bits lie packed in ``low``. ``before`` has the
    number of ones before each 64-bit word of ``high``.
    """

    HEAD = struct.Struct("<QBQQ")

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits = n, low_bits
        self.low = np.lib.stride_tricks.as_strided(low[:8].view("<u8"), shape=(len(low) - 7,), strides=(1,)) if n else None
        self._keep = low
        self.high = high.reshape(-1, 8)
        ones = np.bitwise_count(high.view("<u8")).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.last = len(high) * 8 - n - self.padding(high) if n else 0  # largest upper part in use

    @staticmethod
    def padding(high: np.ndarray) -> int:
        """Zeros after the last one."""
        tail = np.flatnonzero(high[-16:])
        return (min(16, len(high)) - 1 - int(tail[-1])) * 8 + 8 - int(high[-16:][tail[-1]]).bit_length()

    def select(self, i: np.ndarray, ones: bool = True) -> np.ndarray:
        """Positions in ``high`` of the ones, or of the zeros, with the given numbers."""
        out = np.empty(len(i), dtype=np.int64)
        words = np.arange(len(self.before), dtype=np.int64) * 64
        passed = self.before if ones else words - self.before
        for a in range(0, len(i), STEP):
            asked = i[a : a + STEP]
            word = np.searchsorted(passed, asked, "right") - 1
            rest = asked - passed[word]
            block = self.high[word] if ones else ~self.high[word]
            held = np.cumsum(np.bitwise_count(block), axis=1, dtype=np.int64)
            byte = (held <= rest[:, None]).sum(axis=1)
            every = np.arange(len(asked))
            rest -= np.where(byte > 0, held[every, np.maximum(byte - 1, 0)], 0)
            out[a : a + STEP] = words[word] + byte * 8 + _BIT_OF_BYTE[block[every, byte], rest]
        return out

    @classmethod
    def pack(cls, values: np.ndarray) -> bytes:
        """Bytes of a non-decreasing sequence of unsigned 64-bit integers."""
        values = values.astype(np.uint64)
        n = len(values)
        if not n:
            return cls.HEAD.pack(0, 0, 0, 0)
        low_bits = min(57, max(0, int(int(values[-1] + 1) // n).bit_length() - 1))  # eight bytes from any bit hold so many
        span = (n * low_bits + 7) // 8
        low = np.zeros(span + 8, dtype=np.uint8)
        if low_bits:
            shift = np.arange(low_bits, dtype=np.uint64)
            step = 1 << 16  # a multiple of 8 values fills whole bytes
            for a in range(0, n, step):
                bits = ((values[a : a + step, None] >> shift) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(bits.ravel(), bitorder="little")
                low[a * low_bits // 8 : a * low_bits // 8 + len(packed)] = packed
        top = (values >> np.uint64(low_bits)).astype(np.int64)
        marks = np.zeros(n + int(top[-1]) + 1, dtype=np.uint8)
        marks[top + np.arange(n)] = 1
        high = np.packbits(marks, bitorder="little")
        high = np.concatenate([high, np.zeros(-len(high) % 8, dtype=np.uint8)])
        return cls.HEAD.pack(n, low_bits, len(low), len(high)) + low.tobytes() + high.tobytes()

    @classmethod
    def view(cls, buffer: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """The sequence that begins at an offset of a byte buffer, without copying, and the offset after it."""
        n, low_bits, low, high = cls.HEAD.unpack(buffer[at : at + cls.HEAD.size].tobytes())
        at += cls.HEAD.size
        return cls(n, low_bits, buffer[at : at + low], buffer[at + low : at + low + high]), at + low + high

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i * self.low_bits
        return (self.low[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        return ((self.select(i) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(i)

    def _search(self, x: np.ndarray, first: np.ndarray | None, end: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The successor of each x among the values from ``first`` to ``end``, and whether it equals x."""
        x = x.astype(np.uint64)
        first = np.zeros(len(x), dtype=np.int64) if first is None else first
        end = np.full(len(x), self.n, dtype=np.int64) if end is None else end
        if not self.n:
            return np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        top = (x >> np.uint64(self.low_bits)).astype(np.int64)
        # Values with this upper part lie between two zeros; only their lower bits need a search.
        lo, hi = np.zeros(len(x), dtype=np.int64), np.full(len(x), self.n, dtype=np.int64)
        some = np.flatnonzero((top > 0) & (top <= self.last))
        lo[some] = self.select(top[some] - 1, ones=False) - top[some] + 1
        some = np.flatnonzero(top < self.last)
        hi[some] = self.select(top[some], ones=False) - top[some]
        lo = np.clip(np.where(top > self.last, self.n, lo), first, end)
        hi = np.clip(hi, first, end)
        stop = hi.copy()
        want = x & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.lows(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        same = lo < stop
        some = np.flatnonzero(same)
        same[some] = self.lows(lo[some]) == want[some]
        return lo, same

    def successor(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of the first value at or above each x among those from ``first`` to ``end`` (all by default); the end where there is none."""
        return self._search(x, first, end)[0]

    def find(self, x: np.ndarray, first: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Index of each x among the values from ``first`` to ``end``, -1 where they lack it."""
        at, same = self._search(x, first, end)
        return np.where(same, at, -1)

    @property
    def nbytes(self) -> int:
        """Bytes in memory: the packed sequence and its directory."""
        return self._keep.nbytes + self.high.nbytes + self.before.nbytes


def quantise(values: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """One-byte codes and their values: exact up to 256 distinct values, else means of bins that settle by nearest mean."""
    distinct, counts = np.unique(values, return_counts=True)
    if len(distinct) <= 256:
        return np.searchsorted(distinct, values).astype(np.uint8), np.concatenate([distinct, np.zeros(256 - len(distinct))]).astype("<f4")
    means = np.sort(np.concatenate([np.linspace(distinct[0], distinct[-1], 128), distinct[np.arange(128) * (len(distinct) - 1) // 127]]))
    for _ in range(rounds):
        code = np.searchsorted((means[1:] + means[:-1]) / 2, distinct, "right")
        held = np.bincount(code, counts, 256)
        means = np.sort(np.where(held > 0, np.bincount(code, counts * distinct, 256) / np.maximum(held, 1), means))
    return np.searchsorted((means[1:] + means[:-1]) / 2, values, "right").astype(np.uint8), means.astype("<f4")


def _runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and each value's run."""
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


class NgramTrie:
    """Two levels in one buffer: contexts with back-off weights, and their successors with probabilities."""

    MAGIC = b"EFLM"

    def __init__(self, buffer: np.ndarray):
        if bytes(buffer[:4]) != self.MAGIC:
            raise ValueError("not a trie")
        at = 4
        self.contexts, at = EliasFano.view(buffer, at)
        self.words, at = EliasFano.view(buffer, at)
        self.pointers, at = EliasFano.view(buffer, at)
        self.successors, at = EliasFano.view(buffer, at)
        tables = []
        for n in (self.contexts.n, self.successors.n):
            tables.append((buffer[at : at + 1024].view("<f4"), buffer[at + 1024 : at + 1024 + n]))
            at += 1024 + n
        (self.backoff_values, self.backoff_codes), (self.prob_values, self.prob_codes) = tables

    @staticmethod
    def pack(contexts: np.ndarray, owner: np.ndarray, words: np.ndarray, log_probs: np.ndarray, log_backoffs: np.ndarray) -> bytes:
        """``contexts`` sorted; pairs sorted by ``owner`` (rank of the context) and then by ``words``."""
        known, rank = np.unique(words, return_inverse=True)
        starts = np.searchsorted(owner, np.arange(len(contexts) + 1))
        out = [NgramTrie.MAGIC, EliasFano.pack(contexts), EliasFano.pack(known), EliasFano.pack(starts), EliasFano.pack(owner * max(1, len(known)) + rank)]
        for logs in (log_backoffs, log_probs):
            codes, values = quantise(logs) if len(logs) else (np.empty(0, np.uint8), np.zeros(256, "<f4"))
            out += [values.tobytes(), codes.tobytes()]
        return b"".join(out)

    @classmethod
    def mapped(cls, packed: bytes) -> NgramTrie:
        """The trie in an anonymous memory map."""
        space = mmap.mmap(-1, len(packed))
        space.write(packed)
        return cls(np.frombuffer(space, np.uint8))

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        return cls(np.memmap(path, dtype=np.uint8, mode="r"))

    def look_up(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per query the log10 probability (nan if the pair is unseen) and the log10 back-off weight (0 for an unseen context)."""
        fresh, run = _runs_of(contexts)  # equal contexts mostly come in a row
        rank = self.contexts.find(contexts[fresh])[run]
        number = self.words.find(words)
        both = np.flatnonzero((rank >= 0) & (number >= 0))
        log_prob = np.full(len(contexts), np.nan)
        backoff = np.zeros(len(contexts))
        known = rank >= 0
        backoff[known] = self.backoff_values[self.backoff_codes[rank[known]]]
        own = rank[both]
        fresh, run = _runs_of(own)
        first, end = (self.pointers[own[fresh] + k].astype(np.int64)[run] for k in (0, 1))  # the context's own successors
        at = self.successors.find(own * max(1, self.words.n) + number[both], first, end)
        hit = at >= 0
        log_prob[both[hit]] = self.prob_values[self.prob_codes[at[hit]]]
        return log_prob, backoff


# ---------------------------------------------------------------- packing token pairs


def _put(out: io.BytesIO, a: np.ndarray) -> None:
    out.write(struct.pack("<cBQ", a.dtype.kind.encode(), a.dtype.itemsize, len(a)))
    out.write(a.tobytes())


def _narrow(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32)


def _take(data: bytes, at: int) -> tuple[np.ndarray, int]:
    kind, size, n = struct.unpack_from("<cBQ", data, at)
    at += 10
    return np.frombuffer(data, f"<{kind.decode()}{size}", n, at), at + size * n


class Frequent:
    """Words above a share of ``1 / COMMON``, and all that are split as contexts: training counts and numbers of parts, a power of two.

    ``masses`` has the unigram mass of each class of words, as many classes as the most parts.
    """

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, masses: np.ndarray, shards: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.tokens, self.distinct, self.masses, self.shards = tokens, distinct, masses, shards
        self.parts = parts_of(self.counts, tokens / shards)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def split(self, contexts: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of each pair's context (1 if it is not split) and the part that owns the pair."""
        at = self.find(contexts)
        parts = np.where(at >= 0, self.parts[np.maximum(at, 0)], 1) if len(self.parts) else np.ones(len(contexts), dtype=np.int64)
        return parts, (words % parts.astype(np.uint64)).astype(np.int64)

    def shard_of(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        _, part = self.split(contexts, words)
        mixed = (contexts + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed >> np.uint64(32)) % np.uint64(self.shards)).astype(np.int64)


def parts_of(counts: np.ndarray, per_shard: float) -> np.ndarray:
    """Parts of contexts with the given counts: about half a shard each, in powers of two."""
    wanted = np.maximum(1.0, counts * 2 / max(1.0, per_shard))
    return np.minimum(MOST_CLASSES, 2 ** np.ceil(np.log2(wanted)).astype(np.int64)).astype(np.int64)


def pack_chunk(first_row: int, held: list[bool], lines: dict[int, np.ndarray], hashes: np.ndarray, frequent: Frequent) -> Iterator[tuple[int, bytes]]:
    """The token pairs of consecutive rows by shard: contexts, their words, and each word's rows with counts.

    A line holds the numbers of a row's tokens, or of a piece of them, after the
    token before them; ``hashes`` has each number's hash.
    """
    rows, contexts, words = [], [], []
    for row, line in lines.items():
        rows.append(np.full(len(line) - 1, row))
        contexts.append(line[:-1])
        words.append(line[1:])
    if len(hashes) > 1 << 23:  # too many words for the code below: keep those of these lines
        used = np.unique(np.concatenate([*contexts, *words]))
        contexts, words, hashes = [np.searchsorted(used, x) for x in contexts], [np.searchsorted(used, x) for x in words], hashes[used]
    code = (np.concatenate(contexts) << 39) | (np.concatenate(words) << 16) | np.concatenate(rows)
    del rows, contexts, words
    code, times = np.unique(code, return_counts=True)
    pair = code >> 16
    fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
    heads = np.flatnonzero(fresh)
    c, w = hashes[pair[heads] >> 23], hashes[pair[heads] & ((1 << 23) - 1)]
    shard = frequent.shard_of(c, w)
    n_rows = np.diff(np.append(heads, len(code)))
    by_pair = np.argsort(shard, kind="stable")
    by_row = np.argsort(np.repeat(shard, n_rows), kind="stable")
    pair_cut = np.searchsorted(shard[by_pair], np.arange(frequent.shards + 1))
    row_cut = np.concatenate([[0], np.cumsum(np.bincount(shard, n_rows, frequent.shards).astype(np.int64))])
    row = (code & 0xFFFF).astype(np.uint16)[by_row]
    times = times[by_row]
    c, w, n_rows = c[by_pair], w[by_pair], n_rows[by_pair]
    flags = np.packbits(np.array(held, dtype=bool))
    for s in range(frequent.shards):
        a, b = pair_cut[s], pair_cut[s + 1]
        if a == b:
            continue
        run = np.flatnonzero(np.concatenate([[True], c[a + 1 : b] != c[a : b - 1]]))
        out = io.BytesIO()
        out.write(struct.pack("<QQ", first_row, len(held)))
        _put(out, flags)
        _put(out, c[a:b][run])
        _put(out, _narrow(np.diff(np.append(run, b - a))))
        v = w[a:b]
        _put(out, (v >> np.uint64(24)).astype(np.uint32))
        _put(out, ((v >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16))
        _put(out, (v & np.uint64(0xFF)).astype(np.uint8))
        _put(out, _narrow(n_rows[a:b]))
        _put(out, row[row_cut[s] : row_cut[s + 1]])
        _put(out, _narrow(times[row_cut[s] : row_cut[s + 1]]))
        yield s, out.getvalue()


class Packed:
    """One packed part, unpacked."""

    def __init__(self, data: bytes):
        self.first_row, self.n_rows = struct.unpack_from("<QQ", data)
        flags, at = _take(data, 16)
        self.held = np.unpackbits(flags)[: self.n_rows].astype(bool)
        contexts, at = _take(data, at)
        run, at = _take(data, at)
        high, at = _take(data, at)
        middle, at = _take(data, at)
        low, at = _take(data, at)
        self.contexts = np.repeat(contexts, run)
        self.words = high.astype(np.uint64) << np.uint64(24) | middle.astype(np.uint64) << np.uint64(8) | low.astype(np.uint64)
        self.rows_each, at = _take(data, at)
        self.row, at = _take(data, at)
        self.times, at = _take(data, at)


# ---------------------------------------------------------------- one shard: train, then score

PART_BITS = np.uint64(21)  # holds MOST_CLASSES and one more


def nodes_of(contexts: np.ndarray, spread: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct contexts, and each pair's node: its context's rank above the part's number plus one, or 0 where it is not split."""
    own, rank = np.unique(contexts, return_inverse=True)
    return own, rank.astype(np.uint64) << PART_BITS | np.where(spread > 1, part + 1, 0).astype(np.uint64)


def build_trie(nodes: np.ndarray, hashes: np.ndarray, words: np.ndarray, counts: np.ndarray, frequent: Frequent, discount: float) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The trie of training pairs (sorted by node and word), its nodes and the exact counts of their contexts.

    Nodes are those of :func:`nodes_of`, ``hashes`` its contexts. A part of a split
    context has its own successors, the whole context's count, and backs off to the words
    of its class only.
    """
    own, owner = np.unique(nodes, return_inverse=True)
    total = np.bincount(owner, counts, len(own)).astype(float)
    kinds = np.bincount(owner, minlength=len(own))
    at = frequent.find(hashes[own >> PART_BITS])
    hot = at >= 0
    total[hot] = frequent.counts[at[hot]]
    room = np.ones(len(own))  # unigram mass of the words a node backs off to
    part = (own & np.uint64((1 << int(PART_BITS)) - 1)).astype(np.int64) - 1
    for k in np.flatnonzero(part >= 0):
        room[k] = frequent.masses[part[k] :: frequent.parts[at[k]]].sum()
    word_at = frequent.find(words)
    common = word_at >= 0
    floor = frequent.tokens + frequent.distinct + 1
    seen = np.bincount(owner[common], (frequent.counts[word_at[common]] + 1) / floor, len(own))
    log_probs = np.log10((counts - discount) / total[owner])
    log_backoffs = np.log10(discount * kinds / total / np.maximum(room - seen, 1 / floor))
    return NgramTrie.pack(own, owner, words, log_probs, log_backoffs), own, total


def score_shard(parts: list[Packed], frequent: Frequent, discount: float) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Sums per row, and the unseen pairs whose word still needs its unigram probability."""
    offsets = np.cumsum([0, *[p.n_rows for p in parts]])
    held = np.concatenate([p.held for p in parts])
    contexts = np.concatenate([p.contexts for p in parts])
    words = np.concatenate([p.words for p in parts])
    # Split contexts can meet several of their parts in one shard: parts are nodes of their own.
    spread, part = frequent.split(contexts, words)
    hashes, nodes = nodes_of(contexts, spread, part)
    rows_each = np.concatenate([p.rows_each for p in parts])
    row = np.concatenate([p.row.astype(np.int32) + np.int32(o) for p, o in zip(parts, offsets)])
    times = np.concatenate([p.times for p in parts])
    parts.clear()
    del contexts, spread, part
    node_values, node_rank = np.unique(nodes, return_inverse=True)
    del nodes
    word_values, word_rank = np.unique(words, return_inverse=True)
    del words
    node_rank *= len(word_values)
    node_rank += word_rank
    del word_rank
    code, inverse = np.unique(node_rank, return_inverse=True)
    del node_rank
    pair = np.repeat(inverse.astype(np.int32), rows_each)
    del inverse, rows_each
    count = np.bincount(pair, times * ~held[row], len(code))
    own_node, own_word = node_values[code // len(word_values)], word_values[code % len(word_values)]
    trained = count > 0
    buffer, nodes, totals = build_trie(own_node[trained], hashes, own_word[trained], count[trained], frequent, discount)
    trie = NgramTrie.mapped(buffer)
    del buffer
    log_prob, backoff = trie.look_up(own_node, own_word)

    context = hashes[own_node >> PART_BITS]
    at = np.searchsorted(nodes, own_node)
    known_node = np.zeros(len(code), dtype=bool)
    inside = at < len(nodes)
    known_node[inside] = nodes[at[inside]] == own_node[inside]
    total = np.zeros(len(code))
    total[known_node] = totals[at[known_node]]
    hot = frequent.find(context)
    total[hot >= 0] = frequent.counts[hot[hot >= 0]]
    unseen = np.isnan(log_prob)
    partial = np.where(unseen, backoff, log_prob)
    word_hot = frequent.find(own_word)
    settled = unseen & (word_hot >= 0)  # a frequent word's probability is known here
    floor = frequent.tokens + frequent.distinct + 1
    partial[settled] += np.log10((frequent.counts[word_hot[settled]] + 1) / floor)
    is_token = context != np.uint64(END_HASH)
    n = len(held)
    sums = {
        "known": np.bincount(row, times * (is_token & (total > 0))[pair], n).astype(np.int64),
        "base": np.bincount(row, times * (np.log10(total + 1) * is_token)[pair], n),
        "model": np.bincount(row, times * partial[pair], n),
    }
    left = np.flatnonzero((unseen & ~settled)[pair])
    return sums, {"row": row[left], "word": own_word[pair[left]].astype(np.int64), "times": times[left].astype(np.int64)}


# ---------------------------------------------------------------- the Spark job


def count_words(docs: DataFrame, held_col: str = "held") -> DataFrame:
    """``(word, c)``: how often each word's hash, and the end token's, occurs in the rows that are not held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts, size = Numbering({END: 0}), [], 0

        def flush() -> pa.RecordBatch:
            tally = np.bincount(np.concatenate(counts), minlength=len(number))
            return pa.RecordBatch.from_arrays([pa.array(word_hashes(number).astype(np.int64)), pa.array(tally.astype(np.int64))], names=["word", "c"])

        for batch in batches:
            for value in batch.column(0):
                found = lm_words(value.as_py())
                counts.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
                counts.append(np.zeros(1, dtype=np.int64))
                size += len(found)
                if size > 4 * PIECE_WORDS:
                    yield flush()
                    number, counts, size = Numbering({END: 0}), [], 0
        if counts:
            yield flush()

    return docs.where(~F.col(held_col)).select("bytes").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent_words(counts: DataFrame, tokens_per_shard: int = TOKENS_PER_SHARD, most_split: int = MOST_SPLIT) -> Frequent:
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    shards = int(max(8, -(-tokens // tokens_per_shard)))
    floor = tokens + distinct + 1
    least = min(tokens / COMMON, max(tokens / shards / 2, tokens / most_split))
    split = counts.where(F.col("c") > least).toArrow()  # fewer than ``most_split`` by construction
    words, times = split.column("word").to_numpy().astype(np.uint64), split.column("c").to_numpy().astype(float)
    classes = int(parts_of(times, tokens / shards).max(initial=1))
    masses = np.zeros(classes)
    if classes > 1:
        of_class = counts.groupBy(F.pmod("word", F.lit(classes)).alias("k")).agg(F.sum((F.col("c") + 1) / floor).alias("mass")).toArrow()
        masses[of_class.column("k").to_numpy()] = of_class.column("mass").to_numpy()
    return Frequent(words, times, tokens, distinct, masses, shards)


def language_scores(docs: DataFrame, fold: int = 2, folds: int = 7, id_col: str = "doc_id", text_col: str = "text", discount: float = DISCOUNT, tokens_per_shard: int = TOKENS_PER_SHARD) -> DataFrame:
    """``(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per input row."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    marked = docs.select(F.col(id_col), (id_remainder(id_col, folds) == fold).alias("held"), utf8(text_col).alias("bytes"))
    counts = durable(count_words(marked))
    frequent = frequent_words(counts, tokens_per_shard)
    shared = spark.sparkContext.broadcast(frequent)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        done, ids, held, lines, number, size, id_type = 0, [], [], [], Numbering({END: 0}), 0, None

        def part(shard: int, head: int, data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([head], pa.int64()), pa.array([data], pa.binary())], names=["shard", "head", "data"])

        def flush() -> Iterator[pa.RecordBatch]:
            first = (partition << 33) + done
            head = pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(held, pa.bool_()), pa.array([len(x) - 1 for x in lines], pa.int64())], names=["id", "held", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as writer:
                writer.write_batch(head)
            yield part(partition % shared.value.shards, first, sink.getvalue().to_pybytes())
            hashes = word_hashes(number)
            if size < 2 * CHUNK_BYTES:
                pieces = [dict(enumerate(lines))]
            else:  # a very long text among them: row by row, in pieces that overlap by one token
                pieces = ({row: x[a : a + PIECE_WORDS + 1]} for row, x in enumerate(lines) for a in range(0, len(x) - 1, PIECE_WORDS))
            for piece in pieces:
                for shard, data in pack_chunk(first, held, piece, hashes, shared.value):
                    yield part(shard, -1, data)

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, h, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = value.as_py()
                if lines and size + len(text) >= CHUNK_BYTES or len(lines) >= CHUNK_DOCS:
                    yield from flush()
                    done += len(ids)
                    ids, held, lines, number, size = [], [], [], Numbering({END: 0}), 0
                ids.append(i)
                held.append(h)
                found = lm_words(text)
                line = np.zeros(len(found) + 2, dtype=np.int64)
                line[1:-1] = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
                lines.append(line)
                size += len(text)
        if lines:
            yield from flush()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_shard, held_parts = None, []
        for batch in batches:
            for shard, head, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = value.as_py()
                if head >= 0:
                    rows = pa.ipc.open_stream(data).read_all()
                    yield result(np.arange(head, head + rows.num_rows), head=rows)
                    continue
                if shard != held_shard and held_parts:
                    yield from scored(held_parts)
                    held_parts = []
                held_shard = shard
                held_parts.append(Packed(data))
        if held_parts:
            yield from scored(held_parts)

    def scored(parts: list[Packed]) -> Iterator[pa.RecordBatch]:
        rid = np.concatenate([np.arange(p.first_row, p.first_row + p.n_rows) for p in parts]).astype(np.int64)
        sums, left = score_shard(parts, shared.value, discount)
        touched = np.flatnonzero((sums["model"] != 0) | (sums["known"] > 0))
        yield result(rid[touched], sums={k: v[touched] for k, v in sums.items()})
        for a in range(0, len(left["row"]), 1 << 18):
            cut = slice(a, a + (1 << 18))
            yield result(rid[left["row"][cut]], word=left["word"][cut], times=left["times"][cut])

    id_arrow = arrow_type(docs, id_col)

    def result(rid: np.ndarray, head: pa.Table | None = None, sums: dict | None = None, word: np.ndarray | None = None, times: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(rid)
        none = lambda t: pa.nulls(n, t)
        columns = [
            pa.array(rid),
            head.column(0).combine_chunks().cast(id_arrow) if head is not None else none(id_arrow),
            head.column(1).combine_chunks() if head is not None else none(pa.bool_()),
            head.column(2).combine_chunks() if head is not None else none(pa.int64()),
            pa.array(sums["known"]) if sums else none(pa.int64()),
            pa.array(sums["base"]) if sums else none(pa.float64()),
            pa.array(sums["model"]) if sums else none(pa.float64()),
            pa.array(word) if word is not None else none(pa.int64()),
            pa.array(times) if times is not None else none(pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["rid", "id", "held", "n", "known", "base", "model", "word", "times"])

    dealt = marked.mapInArrow(deal, "shard int, head long, data binary").repartition(frequent.shards, "shard").sortWithinPartitions("shard")
    parts = durable(dealt.mapInArrow(work, f"rid long, id {kind}, held boolean, n long, known long, base double, model double, word long, times long"))
    floor = frequent.tokens + frequent.distinct + 1
    unseen = (
        parts.where("word is not null").select("rid", "word", "times").join(counts, "word", "left")
        .select("rid", (F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(floor)))).alias("model"))
    )
    rows = parts.where("word is null").select("rid", "id", "held", "n", "known", "base", "model").unionByName(unseen, allowMissingColumns=True)
    at_end = counts.where(F.col("word") == END_HASH).agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    total = rows.groupBy("rid").agg(
        F.max("id").alias(id_col), F.bool_or("held").alias("held_out"), F.max("n").alias("n_tokens"),
        (F.coalesce(F.sum("known"), F.lit(0)) + (1 if at_end else 0)).alias("n_known"),
        F.coalesce(F.sum("base"), F.lit(0.0)).alias("_base"), F.coalesce(F.sum("model"), F.lit(0.0)).alias("score"),
    )
    base = F.col("_base") + F.lit(math.log10(at_end + 1)) - F.col("n_tokens") * F.lit(math.log10(floor))
    return total.select(id_col, "held_out", "n_tokens", "n_known", F.lit(frequent.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op10_lm(docs: DataFrame) -> DataFrame:
    return language_scores(docs)
