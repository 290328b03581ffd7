"""Byte-pair encoding with a pair occurrence index, and decoding.

A task gathers the distinct pre-tokens of its documents (up to ``chunk_bytes`` of
text at a time) and lays all their symbols in one array. Each adjacent pair
that has a merge rank is indexed with all its positions. The active ranks are
applied in ascending order: all occurrences of a pair are merged at once, the
neighbours' new pairs join their position lists, and stale positions are seen as
such when their rank comes up. Documents are then spelled from their words' ids.

Null texts count as empty. Empty texts have no ids and decode to the empty
text. Texts of any length are processed whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quillspark.llm.common import utf8

CHUNK_BYTES = 8 << 20
WORD_END = "</w>"
_SPACE = r"\t-\r \x85\xa0  -     　"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Vocabulary:
    """Merges, ids and the text steps before them, as a tokenizer file states them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.ids.items()} | {i: t for t, i in special.items()}
        self.special = special
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) or r"(?!)")
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
        self.alphabet = byte_alphabet()
        self.inner = np.array([self.ids.get(c, -1) for c in self.alphabet], dtype=np.int64)
        self.final = np.array([self.ids.get(c + self.end, -1) for c in self.alphabet], dtype=np.int64)
        self.width = max(self.token) + 1
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left.append(self.ids[a])
            right.append(self.ids[b])
            made.append(self.ids[a + b])
        self.left, self.right, self.made = (np.array(x, dtype=np.int64) for x in (left, right, made))
        code = self.left * self.width + self.right
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each adjacent pair, -1 where there is no such merge."""
        if not len(self.codes):
            return np.full(len(left), -1)
        code = left * self.width + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (left >= 0) & (right >= 0), self.order[at], -1)

    def units(self, text: str) -> list[str | tuple[str]]:
        """The text cut at white space and at special tokens; no pre-token crosses such a cut.

        Python also splits at the separators U+001C to U+001F, which are not white
        space here; a text that has them is cut into pre-tokens as a whole, each a
        one-tuple.
        """
        if self.special and "<|" in text and self.cut.search(text):
            out, last = [], 0
            for m in self.cut.finditer(text):
                out += [*self.units(text[last : m.start()]), m[0]]
                last = m.end()
            return out + self.units(text[last:])
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [(w,) for w in self.pretokens(text)]
        return text.split()

    def pretokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() alone would look at a sigma's neighbours
        text = text.lower()
        return [text] if text.isalpha() else self.words.findall(text)


class Numbering(dict):
    """Numbers keys from 0 in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PairIndex:
    """All words of a chunk as one linked array of symbols, with the positions of every rankable pair."""

    def __init__(self, vocab: Vocabulary, words: list[str]):
        self.vocab = vocab
        raw = [w.encode() for w in words]
        flat = np.frombuffer(b"".join(raw), np.uint8)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.stop = np.cumsum(size)
        self.start = self.stop - size
        n = len(flat)
        self.symbol = np.full(n + 1, -1, dtype=np.int64)  # the last slot stands for "no neighbour"
        self.symbol[:n] = vocab.inner[flat]
        tails = self.stop[size > 0] - 1
        self.symbol[tails] = vocab.final[flat[tails]]
        self.next = np.arange(1, n + 2)
        self.prev = np.arange(-1, n)
        self.next[tails] = n
        self.prev[self.start[size > 0]] = n
        self.next[n] = self.prev[n] = n
        self.alive = np.ones(n, dtype=bool)
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        if n:
            self._index(np.flatnonzero(self.next[:n] < n))

    def _index(self, at: np.ndarray) -> None:
        rank = self.vocab.ranks(self.symbol[at], self.symbol[self.next[at]])
        known = rank >= 0
        at, rank = at[known], rank[known]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        keys, first = np.unique(rank[order], return_index=True)
        for r, where in zip(keys.tolist(), np.split(at[order], first[1:])):
            if r in self.places:
                self.places[r].append(where)
            else:
                self.places[r] = [where]
                heapq.heappush(self.active, r)

    def merge(self) -> None:
        symbol, nxt, prv = self.symbol, self.next, self.prev
        while self.active:
            r = heapq.heappop(self.active)
            at = np.concatenate(self.places.pop(r))
            a, b = self.vocab.left[r], self.vocab.right[r]
            at = at[self.alive[at]]
            at = at[(symbol[at] == a) & (symbol[nxt[at]] == b)]
            if not len(at):
                continue
            at = np.unique(at)
            if a == b:
                at = _apart(at, nxt)
            gone = nxt[at]
            after = nxt[gone]
            symbol[at] = self.vocab.made[r]
            symbol[gone] = -1
            self.alive[gone] = False
            nxt[at] = after
            inside = after < len(self.alive)
            prv[after[inside]] = at[inside]
            before = prv[at]
            self._index(np.unique(np.concatenate([before[before < len(self.alive)], at[inside]])))

    def spell(self) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all words, and where each word's ids begin (one more entry than words)."""
        count = np.concatenate([[0], np.cumsum(self.alive)])
        return self.symbol[:-1][self.alive], np.append(count[self.start], count[-1])


def _apart(at: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences of a doubled symbol, every second one from the left."""
    keep, taken = [], -1
    for p in at.tolist():
        if p != taken:
            keep.append(p)
            taken = nxt[p]
    return np.array(keep, dtype=np.int64)


def encode_texts(vocab: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text; equal to encoding them one by one."""
    unit_no, word_no = Numbering(), Numbering()
    docs = [np.array(list(map(unit_no.__getitem__, vocab.units(t))), dtype=np.int64) for t in texts]
    parts, n_parts = [], []
    for unit in unit_no:
        words = unit if isinstance(unit, tuple) else [unit] if unit in vocab.special else vocab.pretokens(unit)
        n_parts.append(len(words))
        parts += map(word_no.__getitem__, words)
    index = PairIndex(vocab, ["" if w in vocab.special else w for w in word_no])
    index.merge()
    ids, begin = index.spell()
    whole = {word_no[t]: i for t, i in vocab.special.items() if t in word_no}
    if whole:
        pieces = [np.array([whole[k]]) if k in whole else ids[begin[k] : begin[k + 1]] for k in range(len(begin) - 1)]
        ids, begin = np.concatenate(pieces), np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
    if (ids < 0).any():
        raise ValueError("the vocabulary lacks a byte")
    ids, size = _gather(ids, begin, np.array(parts, dtype=np.int64))
    ends = np.concatenate([[0], np.cumsum(size)])
    begin = ends[np.concatenate([[0], np.cumsum(np.array(n_parts, dtype=np.int64))])]
    return [_gather(ids, begin, d)[0] for d in docs]


def _gather(ids: np.ndarray, begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``ids[begin[k]:begin[k + 1]]`` for each k of ``at``, end to end, and their lengths."""
    size = begin[at + 1] - begin[at]
    if not len(at):
        return ids[:0], size
    ends = np.cumsum(size)
    return ids[np.repeat(begin[at] - ends + size, size) + np.arange(ends[-1])], size


def decode_ids(vocab: Vocabulary, ids: list[int]) -> str:
    """The tokens of the ids, one space between them: the file names no decoder, so word ends stay visible."""
    return " ".join([vocab.token[i] for i in ids])


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids and texts of consecutive rows, about ``limit`` bytes of text at a time."""
    rows, texts, size = [], [], 0
    for batch in batches:
        for at, value in enumerate(batch.column(1)):
            text = value.as_py() or b""
            rows.append(batch.column(0)[at])
            texts.append(text.decode("utf-8", "replace"))
            size += len(text)
            if size >= limit:
                yield pa.array([r.as_py() for r in rows], batch.schema.field(0).type), texts
                rows, texts, size = [], [], 0
        if texts:
            yield pa.array([r.as_py() for r in rows], batch.schema.field(0).type), texts
            rows, texts, size = [], [], 0


def bpe_encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``(id_col, ids array<int>)`` per input row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for ids, texts in _chunks(batches, chunk_bytes):
            yield pa.RecordBatch.from_arrays([ids, pa.array(encode_texts(vocab, texts), pa.list_(pa.int32()))], names=[id_col, "ids"])

    return docs.select(id_col, utf8(text_col).alias("bytes")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """``(id_col, text)`` from ``(id_col, ids)``; null ids give the empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode_ids(vocab, x or []) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"`{id_col}` {kind}, text string")


def bpe_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Encode, decode the ids, and keep digests of both: one pass that moves no ids between processes."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(tokenizer)
        spelled = {i: str(i) for i in vocab.token}
        for keys, texts in _chunks(batches, chunk_bytes):
            count, first, second = [], [], []
            for ids in encode_texts(vocab, texts):
                ids = ids.tolist()
                count.append(len(ids))
                first.append(hashlib.sha256(" ".join([spelled[i] for i in ids]).encode()).hexdigest())
                second.append(hashlib.sha256(decode_ids(vocab, ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([keys, pa.array(count, pa.int64()), pa.array(first), pa.array(second)], names=names)

    return docs.select(id_col, utf8(text_col).alias("bytes")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(docs: DataFrame) -> DataFrame:
    return bpe_digest(docs, default_tokenizer())
