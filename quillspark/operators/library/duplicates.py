"""Similar images and bursts: an exact cosine join over pivot cells, links from bands of hyperplanes, gap sessions, groups from links."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import connected_components
from quillspark.operators.durable import durable
from quillspark.operators.ranking import stretches

PIVOTS_MOST = 256
CELL_ROWS = 4_000
BLOCK_BYTES = 8 << 20
LEAST_BLOCK = 1_024
SLICE = 256
RECALL = 0.95
MOST_VISITS = 64


def _units(m: np.ndarray) -> np.ndarray:
    m = m.astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    if not len(vectors):
        return np.empty((0, 0))
    out = vectors.flatten().to_numpy(zero_copy_only=False)
    if len(set(np.diff(vectors.offsets.to_numpy()).tolist())) > 1:
        raise ValueError("vectors of unequal length")
    return out.reshape(len(vectors), -1)


def _sound(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v)`` of the vectors that can have links; floats stay floats, all else becomes double."""
    kind = vectors.schema[vec_col].dataType.simpleString()
    v = F.col(vec_col).cast("array<float>" if kind == "array<float>" else "array<double>").alias("v")
    return vectors.select(F.col(id_col).cast("long").alias("id"), v).where("id is not null and v is not null and exists(v, x -> x <> 0)")


def _firsts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(id, v)`` of the smallest id of each vector, and links ``(a, b, cosine)`` from it to its copies."""
    rows = durable(rows)
    firsts = durable(rows.groupBy("v").agg(F.min("id").alias("id")).select("id", "v"))
    copies = rows.join(firsts.withColumnRenamed("id", "first"), "v").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    return firsts, copies


def cosine_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = 0) -> DataFrame:
    """``(a, b, cosine)`` with a < b for all pairs at or above the threshold; exact."""
    return _compared(_sound(vectors, id_col, vec_col), threshold, pivots, spanning=False)


def representative_pairs(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = 0) -> DataFrame:
    """``(a, b, cosine)``: all pairs of different vectors, each by its smallest id, and each copy with that id; ids are unique."""
    firsts, copies = _firsts(_sound(vectors, id_col, vec_col))
    return copies.unionByName(_compared(firsts, threshold, pivots, spanning=False))


def similarity_links(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = 0) -> DataFrame:
    """``(a, b)`` that connect what the pairs at or above the threshold connect: a spanning star per block, not all pairs."""
    firsts, copies = _firsts(_sound(vectors, id_col, vec_col))
    return copies.unionByName(_compared(firsts, threshold, pivots, spanning=True)).select("a", "b")


def _visits(rows: DataFrame, threshold: float, total: int, pivots: int) -> DataFrame | None:
    """``(cell, at_home, id, v)`` of the rows in cells of pivots; null where blocks of all rows would repeat a row less often.

    Pivots, a bounded sample, cut the sphere into cells. A vector lives in its
    nearest pivot's cell and visits every cell that could hold a partner: by the
    triangle inequality on angles, a cell whose pivot is at most twice the threshold
    angle farther than its own. A high threshold keeps visits few; at a low one a
    vector would visit nearly all cells, which the visits of a second sample tell.
    """
    wanted = min(PIVOTS_MOST, pivots or max(1, int(math.sqrt(total / 50))))
    sample = [r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(2 * wanted).select("v").collect()]
    centres = _units(np.array(sample[:wanted]))
    reach = 2 * math.acos(max(-1.0, min(1.0, threshold))) + 1e-9
    angles = lambda units: np.arccos(np.clip(units @ centres.T, -1, 1))
    tried = angles(_units(np.array(sample[wanted:] or sample)))
    if not pivots and (tried <= tried.min(axis=1)[:, None] + reach).sum(axis=1).mean() >= _blocks(total, len(sample[0]))[0]:
        return None

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                angle = angles(_units(_matrix(part.column(1))))
                row, cell = np.nonzero(angle <= angle.min(axis=1)[:, None] + reach)
                yield _visit(part, row, cell, cell == angle.argmin(axis=1)[row])

    return durable(rows.mapInArrow(visit, f"cell long, at_home boolean, id long, v {rows.schema['v'].dataType.simpleString()}"))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, so that what each row's visits repeat stays small."""
    for k in range(0, batch.num_rows, SLICE):
        yield batch.slice(k, SLICE)


def _visit(rows: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, at_home: np.ndarray) -> pa.RecordBatch:
    seen = rows.take(pa.array(row))
    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(at_home), seen.column(0), seen.column(1)], names=["cell", "at_home", "id", "v"])


def _dealt(visits: DataFrame) -> DataFrame:
    """Groups of bounded size in which every resident of a cell meets every visitor once."""
    sizes = visits.groupBy("cell").agg(*[F.greatest(F.lit(1), F.ceil(n / CELL_ROWS)).cast("int").alias(name) for name, n in (("splits", F.count_if("at_home")), ("parts", F.count("*")))])
    dealt = visits.join(sizes, "cell").withColumn("split", F.pmod(F.xxhash64("id", F.lit(1)), "splits").cast("int")).withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), "parts").cast("int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    residents = dealt.where("at_home").withColumn("part", each("parts"))
    visitors = dealt.withColumn("split", each("splits")).withColumn("at_home", F.lit(False))
    return residents.unionByName(visitors).select("cell", "split", "part", "at_home", "id", "v")


PAIR = "a long, b long, cosine double"


def _compared(rows: DataFrame, threshold: float, pivots: int, spanning: bool) -> DataFrame:
    """Pairs of ``(id, v)``, through cells of pivots where these leave something out, else all blocks against each other."""
    rows = durable(rows)
    total = rows.count()
    if not total:
        return rows.sparkSession.createDataFrame([], PAIR)
    visits = _visits(rows, threshold, total, pivots)
    return _across(rows, total, threshold, spanning) if visits is None else _within(_dealt(visits), threshold, spanning)


def _blocks(total: int, width: int) -> tuple[int, int]:
    """How many blocks, and how many rows each: eight blocks or so, more where ``BLOCK_BYTES`` bound them."""
    most = max(1, BLOCK_BYTES // (8 * max(1, width)))
    n = max(1, math.ceil(total / min(most, max(LEAST_BLOCK, total // 8))))
    return n, math.ceil(total / n)


def _across(rows: DataFrame, total: int, threshold: float, spanning: bool) -> DataFrame:
    """Each pair of blocks in a group of its own. Rows are packed by block first, so a row is repeated as a few bytes of a long value."""
    narrow = rows.schema["v"].dataType.simpleString() == "array<float>"
    n = _blocks(total, rows.selectExpr("size(v) as n").first().n)[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, ids, m = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)))
            found = [(k, np.flatnonzero(block == k)) for k in np.unique(block).tolist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in found], pa.int32()), pa.array([ids[x].tobytes() for _, x in found], pa.binary()), pa.array([m[x].astype("<f4" if narrow else "<f8").tobytes() for _, x in found], pa.binary()),
            ], names=["block", "ids", "vectors"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = ([], []), ([], [])
        for batch in batches:
            for upper, i, v in zip(*[batch.column(c).to_pylist() for c in ("upper", "ids", "vectors")]):
                ids[upper].append(np.frombuffer(i, np.int64))
                vectors[upper].append(np.frombuffer(v, "<f4" if narrow else "<f8").reshape(len(ids[upper][-1]), -1))
        if not ids[0]:
            return
        mine, one = np.concatenate(ids[0]), not ids[1]
        units = _units(np.concatenate(vectors[0]))
        theirs, others = (mine, units) if one else (np.concatenate(ids[1]), _units(np.concatenate(vectors[1])))
        vectors[0].clear(), vectors[1].clear()
        place = np.arange(len(mine) + (0 if one else len(theirs)))
        joined = _Stars(len(place)) if spanning else None
        for k in range(0, len(mine), SLICE):
            first = k if one else 0
            cosine = units[k : k + SLICE] @ others[first:].T
            i, j = np.nonzero(cosine >= threshold)
            keep = (j > i) & (mine[k + i] != theirs[first + j]) if one else mine[k + i] != theirs[j]
            i, j = i[keep], j[keep]
            if joined is not None:
                i, j = joined.fresh(place[k : k + SLICE], place[first if one else len(mine) :], i, j)
            u, v = mine[k + i], theirs[first + j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(cosine[i, j])], names=["a", "b", "cosine"])

    packed = rows.select(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n)).cast("int").alias("block"), "id", "v").mapInArrow(pack, "block int, ids binary, vectors binary")
    met = durable(packed).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    jobs = met.select((F.least("block", "other") * n + F.greatest("block", "other")).alias("job"), (F.col("block") > F.col("other")).cast("int").alias("upper"), "ids", "vectors")
    # A group takes far more time than its bytes say, so partitions are not coalesced.
    return jobs.repartition(min(n * (n + 1) // 2, 1_000), "job").groupBy("job").applyInArrow(pair, PAIR)


def _within(blocks: DataFrame, threshold: float, spanning: bool) -> DataFrame:
    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(batches).combine_chunks()
        ids, home = block.column("id").to_numpy(), block.column("at_home").to_numpy().astype(bool)
        units = _units(_matrix(block.column("v").chunk(0)))
        mine, others = np.flatnonzero(home), np.flatnonzero(~home)
        joined = _Stars(len(ids)) if spanning else None
        for k in range(0, len(mine), SLICE):
            rows = mine[k : k + SLICE]
            cosine = units[rows] @ units[others].T
            i, j = np.nonzero(cosine >= threshold)
            keep = ids[rows[i]] < ids[others[j]]
            i, j = i[keep], j[keep]
            if joined is not None:
                i, j = joined.fresh(rows, others, i, j)
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows[i]]), pa.array(ids[others[j]]), pa.array(cosine[i, j])], names=["a", "b", "cosine"])

    # A pair is found where its smaller id is at home, so once.
    return blocks.groupBy("cell", "split", "part").applyInArrow(pair, PAIR)


class Bands(NamedTuple):
    """So many bands of so many hyperplanes each: a vector visits one cell a band."""

    bands: int
    bits: int

    @classmethod
    def planned(cls, rows: int, threshold: float, recall: float = RECALL, most_visits: int = MOST_VISITS) -> Bands:
        """The most bits, up to cells of a row or so, whose bands reach the recall at the threshold within ``most_visits``.

        Two vectors at an angle fall on one side of a random plane with chance ``1 - angle / pi``.
        A low threshold needs many bands of few bits, so its cells stay large; visits are bounded all the same.
        """
        same = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
        best = cls(1, 0)
        for bits in range(1, max(1, math.ceil(math.log2(max(2, rows)))) + 1):
            chance = same**bits
            wanted = 1 if chance >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-chance))
            if wanted <= most_visits:
                best = cls(wanted, bits)
        return best


def banded_links(vectors: DataFrame, threshold: float, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, most_visits: int = MOST_VISITS, spanning: bool = True, seed: int = 11) -> DataFrame:
    """``(a, b, cosine)`` of vectors that share a cell of some band and reach the threshold, by exact cosine.

    Each pair at the threshold is found with chance ``recall`` at least, closer ones more surely.
    Spanning stars per block connect what the found pairs connect; without ``spanning`` all
    found pairs come out. Equal vectors are linked to the smallest id among them and only that one visits
    cells, so copies never meet as pairs; crowded cells are dealt into bounded blocks. Where the
    bands would compare as many pairs as there are, all blocks meet once instead, which loses none. Null
    vectors, and vectors of length zero, have no links; ids are unique.
    """
    firsts, copies = _firsts(_sound(vectors, id_col, vec_col))
    total = firsts.count()
    plan = Bands.planned(total, threshold, recall, most_visits)
    if total and 2 * plan.bands >= 1 << plan.bits:
        return copies.unionByName(_across(firsts, total, threshold, spanning))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = None
        for batch in batches:
            for part in _slices(batch):
                units = _units(_matrix(part.column(1)))
                if planes is None:
                    planes = np.random.default_rng(seed).standard_normal((units.shape[1], plan.bands * plan.bits))
                sides = (units @ planes >= 0).reshape(len(units), plan.bands, plan.bits)
                code = (sides << np.arange(plan.bits)).sum(axis=2)
                cell = (code * plan.bands + np.arange(plan.bands)).astype(np.int64).reshape(-1)
                yield _visit(part, np.repeat(np.arange(len(units)), plan.bands), cell, np.ones(len(cell), bool))

    visits = durable(firsts.mapInArrow(visit, f"cell long, at_home boolean, id long, v {firsts.schema['v'].dataType.simpleString()}"))
    found = _within(_dealt(visits), threshold, spanning)
    return copies.unionByName(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")))


class _Stars:
    """Which links of a block still join two groups."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def fresh(self, rows: np.ndarray, others: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the links, one for each pair of groups that a row joins; a few may be needless, none that joins is left out."""
        u, v = self.label[rows[i]], self.label[others[j]]
        apart = u != v
        first = np.unique(np.stack([u[apart], v[apart]]), axis=1, return_index=True)[1] if apart.any() else np.empty(0, np.int64)
        i, j = i[apart][first], j[apart][first]
        u, v = self.label[rows[i]], self.label[others[j]]
        while len(u):  # groups take the smallest label they are linked to
            low = np.minimum(u, v)
            np.minimum.at(self.label, u, low)
            np.minimum.at(self.label, v, low)
            while not np.array_equal(shorter := self.label[self.label], self.label):
                self.label = shorter
            u, v = self.label[rows[i]], self.label[others[j]]
            u, v = u[u != v], v[u != v]
        return i, j


def similarity_groups(pairs: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` of the transitive closure of the pairs; the component is its smallest member."""
    return connected_components(pairs, left, right)


def bursts(shots: DataFrame, key: str, time: str, gap_seconds: int, tie: str) -> DataFrame:
    """``shots`` with ``burst_no`` from 1: a gap longer than ``gap_seconds`` begins a new burst of its key."""
    timed = shots.withColumn("_micros", F.unix_micros(F.col(time).cast("timestamp")))
    return stretches(timed, key, [F.col(time), F.col(tie)], "_micros", gap_seconds * 1e6, "burst_no").drop("_micros")
