"""Benchmark decontamination by pigeonhole edit matching.

A test item of m characters may occur in a document with up to ``m // per_edit``
edits. Cut into one more piece than that, at least one piece must occur exactly;
an Aho-Corasick automaton finds all piece hits in one pass over the whole text,
and Myers' bit-parallel distance verifies the window around each hit. Texts and
items are compared lower-cased with white space collapsed. With ``whole_words`` a
piece at an item's beginning or end counts only where no letter or digit goes on
outside it, since a few letters occur inside other words; the rule is the same for items of every length.

The benchmark is the stated query set. It is broadcast in blocks whose size is
bounded by ``block_bytes``. With more than one block, each block's result is written
and its broadcast destroyed before the next block is read, so the driver holds one
block at a time; the documents are then read once a block.

Null or blank texts and items match nothing. Repeated items keep their own ids, and
repeated documents their own rows. A null item id is kept as null; ids may have any
type. Of an item's occurrences with equal distances the first counts. An empty table of
documents or items gives no hits and drops nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import arrow_type
from quillspark.operators.durable import durable, release

PER_EDIT = 20
BLOCK_BYTES = 4 << 20


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers_search(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any substring of ``text``, and the end of the first such substring."""
    m = len(pattern)
    if not m:
        return 0, 0
    where: dict[str, int] = {}
    for k, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(xh | plus))
        down = plus & xh
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, j
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(xv | up))
        minus = up & xv
    return best, end


class PieceIndex:
    """Automaton over the pieces of a block of items; ``match`` finds all items within their budgets."""

    def __init__(self, items: list[tuple[object, str]], per_edit: int = PER_EDIT, whole_words: bool = True):
        self.whole_words = whole_words
        self.items = [(i, s, len(s) // per_edit) for i, t in items if (s := normalise(t))]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, s, budget) in enumerate(self.items):
            cuts = [len(s) * j // (budget + 1) for j in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(s[a:b], []).append((k, a))
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, (len(piece), at))
        if pieces:
            self.automaton.make_automaton()

    def match(self, text: str | None) -> list[tuple[object, int, int]]:
        """``(item id, edit distance, end in the normalised text)`` of each item's closest occurrence."""
        if not self.items:
            return []
        s = normalise(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (size, at) in self.automaton.iter(s):
            for k, offset in at:
                _, item, budget = self.items[k]
                if self.whole_words and (offset == 0 and inside_word(s, last + 1 - size) or offset + size == len(item) and inside_word(s, last + 1)):
                    continue
                start = last + 1 - size - offset
                lo, hi = max(0, start - budget), start + len(item) + budget
                spans = windows.setdefault(k, [])
                if spans and lo <= spans[-1][1]:
                    spans[-1] = [min(lo, spans[-1][0]), max(hi, spans[-1][1])]
                else:
                    spans.append([lo, hi])
        found = []
        for k, spans in windows.items():
            name, item, budget = self.items[k]
            best = None
            for lo, hi in spans:
                at = s.find(item, lo, hi)
                distance, end = (0, at + len(item)) if at >= 0 else myers_search(item, s[lo:hi])
                end += 0 if at >= 0 else lo
                if distance <= budget and (best is None or (distance, end) < best[1:]):
                    best = (name, distance, end)
            if best:
                found.append(best)
        return found


def inside_word(text: str, at: int) -> bool:
    """Whether a place lies between two letters or digits."""
    return 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum()


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[bool, list[tuple[object, str]]]]:
    """``(last, items)``: blocks of bounded size; one aggregate fixes the number of blocks, each is read on its own."""
    items = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    count = total // block_bytes + 1
    for k in range(count):
        block = items if count == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
        yield k == count - 1, [tuple(r) for r in block.collect()]


def _with_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int, step: Callable[[Broadcast, DataFrame | None], DataFrame]) -> DataFrame:
    """``step(block, result so far)`` for each block in turn; what it returns is written out where there are several."""
    sc, out = docs.sparkSession.sparkContext, None
    for last, block in _blocks(benchmark, item_col, item_text, block_bytes):
        shared = sc.broadcast(block)
        if last and out is None:
            return step(shared, None)
        before, out = out, durable(step(shared, out))
        if before is not None:
            release(before)
        shared.destroy()
    return out


def benchmark_hits(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", per_edit: int = PER_EDIT, whole_words: bool = True, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id_col, item_col, distance, end_char)``: each document and item that occurs in it within its budget."""
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    arrow = [arrow_type(docs, id_col), arrow_type(benchmark, item_col), pa.int32(), pa.int64()]

    def step(shared: Broadcast, before: DataFrame | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = PieceIndex(shared.value, per_edit, whole_words)
            for batch in batches:
                rows = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for hit in index.match(t.as_py())]
                columns = zip(*rows) if rows else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, arrow)], names=["i", "j", "distance", "end_char"])

        found = docs.select(id_col, text_col).mapInArrow(run, f"i {kinds[0]}, j {kinds[1]}, distance int, end_char long")
        return found if before is None else before.unionByName(found)

    return _with_blocks(docs, benchmark, item_col, item_text, block_bytes, step).select(F.col("i").alias(id_col), F.col("j").alias(item_col), "distance", "end_char")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", per_edit: int = PER_EDIT, whole_words: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item occurs; a map over rows, without any shuffle."""
    at = docs.columns.index(text_col)

    def step(shared: Broadcast, before: DataFrame | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = PieceIndex(shared.value, per_edit, whole_words)
            for batch in batches:
                yield batch.filter(pa.array([not index.match(t.as_py()) for t in batch.column(at)], pa.bool_()))

        return (docs if before is None else before).mapInArrow(run, docs.schema)

    return _with_blocks(docs, benchmark, item_col, item_text, block_bytes, step)


def op9_decontam(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return benchmark_hits(docs, benchmark)
