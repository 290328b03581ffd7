"""SimHash near-duplicate detection with sharded BK-trees.

1. Fingerprint: 64 bits from XXH64 of word shingles, one pass over the texts.
2. Shards: two fingerprints that differ in at most ``radius`` bits agree on at
   least one of ``radius + 1`` bit blocks (pigeonhole), so each distinct
   fingerprint goes to the shard of each of its block values. A shard with more
   than ``shard_cap`` fingerprints is split again by the blocks of the remaining
   bits, which again loses no pair. What is still crowded is dealt into blocks, and
   each pair of blocks is a job: the cap only chooses the key, it never drops rows.
3. Each shard is a BK-tree (a child hangs on the edge numbered by its integer Hamming
   distance to the parent) that its members search, following only edges within the
   radius. The trees live in the task that owns the shard: they hold the fingerprints
   of all documents between them, which have no bound that would allow a broadcast.
   A job returns a spanning star of its links, never all pairs.
4. The links of all shards are joined into components by Spark joins.

A radius of 4 bits finds texts that are all but equal. ``near_duplicates`` can also be
given a Jaccard similarity of word shingles. Fingerprints count repeated shingles and
sets do not, so they take no part in it. Its shards are keyed by min-hashes (a pair at
0.8 shares none of the ``KEYS`` keys once in 15,000 times). One-byte min-hash sketches and set sizes only sort
out texts without any partner; what is left is linked where the exact sets of shingle
hashes have the similarity. Texts with equal sets are one entry.

A shard with more entries than a block first compares all its entries with a few
leaders, block by block: in a group of near copies this links nearly all of them.
Entries with the same links so far are not compared again. Those outside the shard's
largest linked group are dealt into blocks, and each of these meets every other block in
a job of its own. A task holds two blocks at most and no pair is lost.

Null or blank texts get fingerprint zero and are linked like any other. Equal
fingerprints are one node, so repeated rows cost one tree entry. An empty table gives
an empty result. A component is named by its smallest id, so ties need no order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import fresh, utf8
from quillspark.operators.components import connected_components
from quillspark.operators.durable import durable, release

SEED = 42
KEYS = 6
SKETCH = 128
SLACK = 0.03  # about one standard error of a sketch's estimate
LOOSE = 5 * SLACK  # a sketch rejects a pair only this far below the similarity
BLOCK = 1024
SET_BLOCK = 512  # sets of hashes are longer than sketches
LEADERS = 16
FOREST_ROWS = 1 << 16
VISITS = 1 << 21  # of (query, node) pairs that one level of a search may hold
SMALL = 256  # nor does it reject a set with fewer shingles, of which one fills several bins
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` lower-cased (A-Z) words, repeats included; of all words where there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(words)
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    if n <= 1:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *[g + 1 for g in gaps[: n - 1]]]
    ends = [*gaps[shingle - 1 :], len(joined)]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of a UTF-8 text: a bit is set where more than half of the shingle hashes have it; 0 without words."""
    found = shingle_hashes(text, shingle)
    n = len(found)
    hashes = found.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 300:
        ones = np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(hashes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, KEYS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, shingle: int = 5) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def set_digest(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.astype("<u8").tobytes(), SEED)


def sketch(text: bytes, shingle: int = 5) -> tuple[list[int], bytes]:
    return _set_sketch(shingle_set(text, shingle))


def _set_sketch(found: np.ndarray) -> tuple[list[int], bytes]:
    """Min-hash keys and a one-permutation min-hash sketch of a set of shingles; no keys without words.

    Bin k keeps a byte of the least hash whose upper bits are k; an empty bin takes
    the next filled one's.
    """
    if not len(found):
        return [], bytes(SKETCH)
    keys = [int((found * odd).min()) for odd in _ODD]
    first = np.searchsorted(found, np.arange(SKETCH, dtype=np.uint64) << np.uint64(64 - SKETCH.bit_length() + 1))
    mixed = found * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)
    return keys, mixed[first % len(found)].astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, sketched: int = 0) -> DataFrame:
    """``(id_col, fp, tid)``, one row per input row; ``fp`` holds the 64 bits as a signed long, ``tid`` a hash of the text.

    With ``sketched`` words per shingle, also ``keys array<long>``, ``sketch binary``, and the
    digest ``whole`` and size ``n`` of the set of shingles.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, fp long, tid long" + (", keys array<long>, sketch binary, whole long, n int" if sketched else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            fps = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
            columns, names = [batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], [id_col, "fp", "tid"]
            if sketched:
                sets = [shingle_set(t, sketched) for t in texts]
                found = [_set_sketch(x) for x in sets]
                keys = [np.array(k, dtype=np.uint64).view(np.int64) for k, _ in found]
                columns += [pa.array(keys, pa.list_(pa.int64())), pa.array([x for _, x in found], pa.binary())]
                whole = np.array([set_digest(x) for x in sets], dtype=np.uint64).view(np.int64)
                columns += [pa.array(whole), pa.array([len(x) for x in sets], pa.int32())]
                names += ["keys", "sketch", "whole", "n"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(id_col, utf8(text_col).alias("bytes"), F.xxhash64(utf8(text_col)).alias("tid")).mapInArrow(run, schema)


class BKForest:
    """BK-trees over 64-bit codes, one for each shard: a child hangs on the edge numbered by its Hamming distance to the parent.

    Trees are built and searched level by level, those of all shards at once. Node k
    is ``codes[k]``; ``slots`` holds ``parent * 65 + edge`` of all children in order and
    ``kids`` their nodes.
    """

    def __init__(self, codes: np.ndarray, shard: np.ndarray):
        """``shard``: the shard of each code, non-decreasing; a shard's first code is its root."""
        self.codes = codes
        fresh = np.concatenate([[True], shard[1:] != shard[:-1]]) if len(codes) else np.empty(0, bool)
        self.roots = np.flatnonzero(fresh)
        at = self.roots[np.cumsum(fresh) - 1]
        rest = np.flatnonzero(~fresh)
        at, slots, kids = at[rest], [], []
        while len(rest):
            place = at * 65 + np.bitwise_count(codes[rest] ^ codes[at])
            order = np.argsort(place, kind="stable")
            place, rest = place[order], rest[order]
            first = np.concatenate([[True], place[1:] != place[:-1]])
            slots.append(place[first])
            kids.append(rest[first])
            at = rest[first][np.cumsum(first) - 1][~first]
            rest = rest[~first]
        self.slots = np.concatenate([*slots, np.empty(0, np.int64)])
        order = np.argsort(self.slots)
        self.slots, self.kids = self.slots[order], np.concatenate([*kids, np.empty(0, np.int64)])[order]

    def search(self, asked: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(query, node)`` pairs within the radius, level by level; each query starts at its root."""
        query, node = np.arange(len(asked)), roots
        while len(query):
            apart = np.bitwise_count(asked[query] ^ self.codes[node]).astype(np.int64)
            near = apart <= radius
            yield query[near], node[near]
            lo = np.searchsorted(self.slots, node * 65 + np.maximum(apart - radius, 0))
            hi = np.searchsorted(self.slots, node * 65 + np.minimum(apart + radius, 64), "right")
            n = hi - lo
            ends = np.cumsum(n)
            query = np.repeat(query, n)
            node = self.kids[np.arange(len(query)) + np.repeat(lo - ends + n, n)]


def linked_codes(codes: np.ndarray, shard: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """For each code the smallest index it is connected to by links within the radius inside its shard.

    Codes of side 1 are compared with those of side 0 only; side -1 compares with all.
    """
    label = np.arange(len(codes))
    nodes, asking = np.flatnonzero(side <= 0), np.flatnonzero(side != 0)
    forest = BKForest(codes[nodes], shard[nodes])
    known = shard[nodes][forest.roots]
    tree = np.searchsorted(known, shard[asking])
    inside = tree < len(known)
    inside[inside] = known[tree[inside]] == shard[asking][inside]
    asking, tree = asking[inside], tree[inside]
    size = np.diff(np.append(forest.roots, len(nodes)))
    visits = np.cumsum(size[tree])
    a = 0
    while a < len(asking):
        b = max(a + 1, int(np.searchsorted(visits, (visits[a - 1] if a else 0) + VISITS, "right")))
        for query, node in forest.search(codes[asking[a:b]], forest.roots[tree[a:b]], radius):
            _join(label, asking[a + query], nodes[node])
        a = b
    return label


def _join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Give all that the pairs connect the smallest of their labels; a label is an index that labels itself."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(shorter := label[label], label):
            label[:] = shorter


def _block(fp: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _blocks(total: int, parts: int) -> list[tuple[int, int]]:
    """``parts`` contiguous bit ranges (shift, width) that cover ``total`` bits."""
    bounds = [total * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def _keys(codes: DataFrame, radius: int, shard_cap: int) -> DataFrame:
    """``(key, fp)``: one row for each shard a fingerprint belongs to."""
    blocks = _blocks(64, radius + 1)
    first = codes.select(
        "fp",
        F.posexplode(F.array(*[_block(F.col("fp"), s, w) for s, w in blocks])).alias("i", "value"),
    )
    crowded = first.groupBy("i", "value").count().where(F.col("count") > shard_cap).select("i", "value", F.lit(True).alias("crowded"))
    sized = first.join(crowded, ["i", "value"], "left")
    # Rotated right by shift + width, a code has the block on top and the remaining bits below it.
    turned = [
        F.col("fp") if s + w == 64 else F.shiftrightunsigned("fp", s + w).bitwiseOR(F.shiftleft("fp", 64 - s - w))
        for s, w in blocks
    ]
    rest = F.coalesce(*[F.when(F.col("i") == k, t) for k, t in enumerate(turned)])
    inner = F.array(*[
        F.array(*[F.xxhash64(F.col("i"), F.col("value"), F.lit(j), _block(rest, s, n)) for j, (s, n) in enumerate(_blocks(64 - w, radius + 1))])
        for _, w in blocks
    ])
    keys = F.when(F.col("crowded"), F.get(inner, F.col("i"))).otherwise(F.array(F.xxhash64("i", "value", F.lit(-1))))
    return sized.select(F.explode(keys).alias("key"), "fp")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Each run of two or more rows with equal values in the first column; runs may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(key)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(key)]):
            if b - a == 1 and a > 0 and b < len(key):
                continue
            if held and key[a] != last:
                if len(held) > 1 or held[0].num_rows > 1:
                    yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
                last = key[a]
    if len(held) > 1 or held and held[0].num_rows > 1:
        yield pa.Table.from_batches(held)


def _pairs(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])


def _fixed(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _whole_runs(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of whole runs of equal values in the first column, which ascends; about ``rows`` rows each, or one run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _jobs(entries: DataFrame, block: int, by: str) -> DataFrame:
    """``entries`` with ``job`` and ``side``: a shard as it is (side -1), or pairs of blocks of a crowded one.

    Blocks are dealt by a hash of the column ``by``, which is unique in a shard. With a
    column ``label``, entries of one label need no comparison: those of a shard's most frequent
    label make blocks of their own, which do not meet each other. A job of two
    different blocks compares across them (sides 0 and 1) only. The table of crowded
    shards is small: one row for ``block`` entries or more.
    """
    sized = durable(entries.groupBy("key").agg(F.count("*").alias("n_all")).where(F.col("n_all") > block))
    if "label" in entries.columns:
        grouped = entries.join(sized, "key").groupBy("key", "n_all", "label").agg(F.count("*").alias("n_same"))
        largest = grouped.groupBy("key", "n_all").agg(F.max(F.struct("n_same", "label")).alias("x"))
        sized = largest.select("key", F.col("x.label").alias("main"), (F.col("n_all") - F.col("x.n_same")).alias("n_out"), F.col("x.n_same").alias("n_in"))
    else:
        sized = sized.select("key", F.lit(None).cast("long").alias("main"), F.col("n_all").alias("n_out"), F.lit(0).cast("long").alias("n_in"))
    parts = lambda n: F.ceil(F.col(n) / block).cast("int")
    crowded = durable(sized.select("key", "main", parts("n_out").alias("outer"), parts("n_in").alias("inner")))
    same = F.col("label") == F.col("main") if "label" in entries.columns else F.lit(False)
    met = (
        entries.join(crowded, "key", "left").withColumn("same", F.coalesce(same, F.lit(False)))
        .withColumn("part", F.expr(f"case when outer is null then 0 when same then outer + cast(pmod(xxhash64(`{by}`, 7), inner) as int) else cast(pmod(xxhash64(`{by}`, 7), outer) as int) end"))
        .withColumn("other", F.explode(F.expr("case when outer is null then array(0) when same and outer = 0 then cast(array() as array<int>) when same then sequence(0, outer - 1) else sequence(0, outer + inner - 1) end")))
    )
    return met.select(
        F.when(F.col("outer").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))).alias("job"),
        F.when(F.col("part") == F.col("other"), -1).otherwise((F.col("part") > F.col("other")).cast("int")).alias("side"),
        *entries.columns,
    )


def _dealt(jobs: DataFrame, *order: str) -> DataFrame:
    """Whole jobs in order, in as many tasks as the session shuffles to: a job takes far more time than its bytes say, so they are not coalesced."""
    return jobs.repartition(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "job").sortWithinPartitions("job", *order)


def _linked(jobs: DataFrame, radius: int) -> DataFrame:
    """``(u, v)``: a spanning star of each linked set of codes in each of the jobs ``(job, side, fp)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_runs(batches, FOREST_ROWS):
            codes = rows.column("fp").to_numpy().view(np.uint64)
            label = linked_codes(codes, rows.column("job").to_numpy(), rows.column("side").to_numpy(), radius)
            joined = np.flatnonzero(codes[label] != codes)
            if len(joined):
                yield _pairs([codes[joined]], [codes[label[joined]]])

    return _dealt(jobs.select("job", "side", "fp")).mapInArrow(run, "u long, v long")


def fingerprint_links(codes: DataFrame, radius: int = 4, shard_cap: int = 4096) -> DataFrame:
    """``(u, v)``: links within the radius between distinct fingerprints, thinned to a spanning star per job."""
    return _linked(_jobs(_keys(codes, radius, shard_cap), shard_cap, "fp"), radius)


class _Shard:
    """Entries of one job: which may be similar by set size and sketch."""

    def __init__(self, rows: pa.Table, similarity: float):
        self.n = rows.column("n").to_numpy()
        self.label = rows.column("label").to_numpy()
        self.marks = _fixed(rows.column("sketch"), np.uint8).reshape(-1, SKETCH)
        self.side = rows.column("side").to_numpy()
        self.similarity = similarity
        self.least = ((similarity - LOOSE) * 255 + 1) / 256 * SKETCH  # unequal hashes share a byte once in 256

    def loose(self, p: int, others: np.ndarray) -> np.ndarray:
        """Of ``others``, those whose exact similarity to ``p`` has to be found out."""
        n, m = self.n[others], self.n[p]
        fits = np.minimum(n, m) >= self.similarity * np.maximum(n, m) - 1e-9
        others, n = others[fits], n[fits]
        if m < SMALL:
            return others
        return others[(n < SMALL) | ((self.marks[others] == self.marks[p]).sum(axis=1) >= self.least)]

    def apart(self, p: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` have other links than ``p``, and are of the other block where the job has two."""
        wanted = self.label[others] != self.label[p]
        return wanted if self.side[p] < 0 else wanted & (self.side[others] != self.side[p])


class _Sets:
    """Exact similarities of the sets of one job.

    Numbered by how many sets hold it, a hash is the later the more common it is. Two
    sets with the similarity share one of their first hashes (all but the share that
    may be missing, and one more), so only sets that meet in such a prefix are compared.
    """

    def __init__(self, sets: list[np.ndarray], similarity: float):
        self.n = np.array([len(x) for x in sets])
        ids, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        place = np.empty(len(times), np.int64)
        place[np.argsort(times, kind="stable")] = np.arange(len(times))
        owner = np.repeat(np.arange(len(sets)), self.n)
        order = np.lexsort((place[ids], owner))
        self.ids = place[ids][order]
        self.ends = np.cumsum(self.n)
        self.starts = self.ends - self.n
        self.marked = np.zeros(len(times), bool)
        self.prefix = self.n - np.ceil(similarity * self.n - 1e-9).astype(np.int64) + 1
        first = np.arange(len(owner)) - self.starts[owner] < self.prefix[owner]
        held, by = self.ids[first], owner[first]
        order = np.argsort(held, kind="stable")
        self.held, self.by = held[order], by[order]  # ascending sets per hash

    def met(self, p: int) -> np.ndarray:
        """The sets after ``p`` that share a hash of its prefix."""
        mine = self.ids[self.starts[p] : self.starts[p] + self.prefix[p]]
        lo, hi = np.searchsorted(self.held, mine), np.searchsorted(self.held, mine, "right")
        found = np.unique(np.concatenate([self.by[a:b] for a, b in zip(lo.tolist(), hi.tolist())]))
        return found[found > p]

    def similarity(self, p: int, others: np.ndarray) -> np.ndarray:
        mine = self.ids[self.starts[p] : self.ends[p]]
        self.marked[mine] = True
        n = self.n[others]
        starts = np.cumsum(n) - n
        both = np.add.reduceat(self.marked[np.concatenate([self.ids[self.starts[q] : self.ends[q]] for q in others.tolist()])], starts, dtype=np.int64)
        self.marked[mine] = False
        return both / (n + self.n[p] - both)


def _with_partner(entries: DataFrame, crowded: DataFrame | None, similarity: float, block: int) -> DataFrame:
    """``(key, whole, label)`` of the entries ``(key, whole, label, n, sketch)`` that may be similar to another of their shard.

    ``crowded`` holds the entries of shards with more than a block; only these are dealt into blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            shard = _Shard(rows, similarity)
            found = np.zeros(len(shard.n), bool)
            for p in range(len(found)):
                later = np.arange(p + 1, len(found))
                hits = shard.loose(p, later[shard.apart(p, later)])
                found[hits] = True
                found[p] |= len(hits) > 0
            if found.any():
                yield from rows.select(["key", "whole", "label"]).filter(pa.array(found)).to_batches()

    names = ["job", "side", "key", "whole", "label", "n", "sketch"]
    jobs = entries.select(F.col("key").alias("job"), F.lit(-1).alias("side"), *names[2:])
    if crowded is not None:
        jobs = jobs.unionByName(_jobs(crowded, block, "whole").select(names))
    return _dealt(jobs).mapInArrow(run, "key long, whole long, label long")


def _exact_links(jobs: DataFrame, similarity: float) -> DataFrame:
    """``(u, v)``: fingerprints of entries ``(job, side, label, fp, n, sketch, hashes)`` with similar sets, a spanning forest per job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            shard, us, vs = _Shard(rows, similarity), [], []
            fp = rows.column("fp").to_numpy().view(np.uint64)
            sets = _Sets([np.frombuffer(x, "<u8") for x in rows.column("hashes").to_pylist()], similarity)
            label = np.unique(shard.label, return_inverse=True)[1]
            for p in range(len(fp)):
                later = sets.met(p)
                others = shard.loose(p, later[shard.apart(p, later) & (label[later] != label[p])])
                if not len(others):
                    continue
                for q in others[sets.similarity(p, others) >= similarity].tolist():
                    if label[q] != label[p]:
                        label[label == label[q]] = label[p]
                        us.append(fp[p])
                        vs.append(fp[q])
            if us:
                yield _pairs([np.array(us)], [np.array(vs)])

    # Leaders, side 0, come first: each is compared with the whole block at once.
    return _dealt(jobs.select("job", "side", "label", "fp", "n", "sketch", "hashes"), "side").mapInArrow(run, "u long, v long")


def _sets_of(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, firsts: DataFrame, shingle: int) -> DataFrame:
    """``(whole, fp, n, sketch, hashes)`` of the sets in ``wanted``: ``(tid, whole, fp)``; the texts are read again.

    ``firsts`` names one id for each text, so copies of a text are dealt apart and only one of them is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, rows = batch.column(1).to_numpy(zero_copy_only=False), []
            sets = [shingle_set(t, shingle) for t in batch.column(0).to_pylist()]
            rows = [k for k, x in enumerate(sets) if set_digest(x) == int(whole[k]) % (1 << 64)]
            sets, kept = [sets[k] for k in rows], batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([
                kept.column(1), kept.column(2), pa.array([len(x) for x in sets], pa.int32()),
                pa.array([_set_sketch(x)[1] for x in sets], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary()),
            ], names=["whole", "fp", "n", "sketch", "hashes"])

    texts = docs.select(F.col(id_col).alias("own"), utf8(text_col).alias("bytes")).withColumn("tid", F.xxhash64("bytes"))
    named = wanted.join(firsts, "tid").withColumnRenamed("tid", "of")
    # The list of texts grows with the table: by this hint it is never broadcast.
    found = texts.join(named.hint("merge"), (F.col("tid") == F.col("of")) & F.col("own").eqNullSafe(F.col("first"))).dropDuplicates(["tid", "whole"])
    return found.select("bytes", "whole", "fp").mapInArrow(run, "whole long, fp long, n int, sketch binary, hashes binary")


def _leader_links(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, firsts: DataFrame, home: DataFrame, similarity: float, shingle: int, block: int) -> DataFrame:
    """Links between entries of crowded shards and the leaders of their ``home (whole, key)`` shard, written out.

    Leaders are the entries with the least hash in each of ``LEADERS`` slots, so every
    task that holds a block of the shard compares it with the same few.
    """
    exact = durable(_sets_of(docs, id_col, text_col, sets.join(home, "whole").select("tid", "whole", "fp"), firsts, shingle))
    members = exact.join(home, "whole").withColumn("turn", F.xxhash64("whole", F.lit(5))).withColumn("label", F.col("fp"))
    slot = F.pmod(F.xxhash64("whole", F.lit(3)), F.lit(LEADERS)).alias("slot")
    first = durable(home.groupBy("key", slot).agg(F.min(F.xxhash64("whole", F.lit(5))).alias("turn")).select("key", "turn").distinct())
    parts = durable(home.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")))
    held = members.join(parts, "key")
    part = F.pmod(F.xxhash64("whole", F.lit(7)), "parts").cast("int")
    led = held.join(first, ["key", "turn"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(0))
    jobs = held.withColumn("part", part).withColumn("side", F.lit(1)).unionByName(led)
    links = durable(_exact_links(jobs.withColumn("job", F.xxhash64("key", "part")), similarity))
    for done in (exact, first, parts):
        release(done)
    return links


def similarity_links(docs: DataFrame, marked: DataFrame, similarity: float, text_col: str = "text", shingle: int = 5, block: int = BLOCK, set_block: int = SET_BLOCK, id_col: str = "doc_id") -> DataFrame:
    """``(u, v)``: links between fingerprints of texts whose sets of shingles have the similarity; written out."""
    sets = durable(
        marked.where(F.size("keys") > 0).groupBy("whole")
        .agg(F.min(F.struct("fp", "tid", "n", "sketch", "keys")).alias("x")).select("whole", "x.*")
    )
    firsts = durable(marked.groupBy("tid").agg(F.min(id_col).alias("first")))
    links = marked.join(sets.select("whole", F.col("fp").alias("low")), "whole").where("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v")).distinct()
    entries = sets.select(F.posexplode("keys").alias("i", "least"), "whole", "fp", "n", "sketch").withColumn("key", F.xxhash64("i", "least")).drop("i", "least")
    crowded = durable(entries.groupBy("key").count().where(F.col("count") > block))
    home = durable(entries.join(crowded, "key").groupBy("whole").agg(F.max(F.struct("count", "key"))["key"].alias("key")))
    labelled, inside, used = entries.withColumn("label", F.col("fp")), None, [sets, firsts, crowded, home]
    if not home.isEmpty():
        led = _leader_links(docs, id_col, text_col, sets, firsts, home, similarity, shingle, set_block)
        links = links.unionByName(led)
        groups = connected_components(led).select(F.col("node").alias("fp"), F.col("component").alias("group"))
        # Only in crowded shards is it worth a join to know what the leaders have linked.
        inside = durable(entries.join(crowded.select("key"), "key").join(groups, "fp", "left").withColumn("label", F.coalesce("group", "fp")).drop("group"))
        labelled = labelled.join(crowded.select("key"), "key", "left_anti")
        used += [led, inside]
    near = durable(_with_partner(labelled, inside, similarity, block).distinct())
    wanted = sets.join(near.select("whole").distinct(), "whole").select("tid", "whole", "fp")
    exact = durable(_sets_of(docs, id_col, text_col, wanted, firsts, shingle))
    jobs = _jobs(near, set_block, "whole").select("job", "side", "whole", "label").join(exact.hint("merge"), "whole")
    out = durable(links.unionByName(_exact_links(jobs, similarity)))
    for done in (*used, near, exact):
        release(done)
    return out


def _rooted(docs: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, shard_cap: int, similarity: float | None, similarity_shingle: int) -> tuple[DataFrame, DataFrame]:
    """The marked rows, and ``(fp, root)``: the fingerprint that stands for each one's component. Both are written out."""
    marked = durable(fingerprints(docs, id_col, text_col, shingle, similarity_shingle if similarity else 0))
    codes = marked.select("fp").distinct()
    links = fingerprint_links(codes, radius, shard_cap)
    if similarity:
        links = links.unionByName(similarity_links(docs, marked, similarity, text_col, similarity_shingle, id_col=id_col))
    comps = connected_components(links)
    rooted = durable(codes.join(comps.withColumnsRenamed({"node": "fp", "component": "root"}), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))
    for done in (comps, links):
        release(done)
    return marked, rooted


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, shard_cap: int = 4096,
    similarity: float | None = None, similarity_shingle: int = 5,
) -> DataFrame:
    """``(id_col, fp, component_id)`` per input row; the component is the smallest id reachable by links, itself included.

    With a ``similarity``, texts whose shingle sets are that similar are linked too. A
    null id takes part in linking but never names a component; a component of
    null ids only has a null name.
    """
    marked, rooted = _rooted(docs, id_col, text_col, shingle, radius, shard_cap, similarity, similarity_shingle)
    lows = marked.groupBy("fp").agg(F.min(id_col).alias("low"))
    names = lows.join(rooted, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(names, "root").select("fp", "component_id")
    return marked.select(id_col, "fp").join(named, "fp").select(id_col, "fp", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, shard_cap: int = 4096,
    similarity: float | None = None, similarity_shingle: int = 5,
) -> DataFrame:
    """One row of each component: the one with the smallest id, of equal ids that whose text hashes lowest.

    Rows are told apart by id and text, so one id with two unrelated texts keeps both;
    of rows equal in both, one stays. Rows without an id stay.
    """
    marked, rooted = _rooted(docs, id_col, text_col, shingle, radius, shard_cap, similarity, similarity_shingle)
    hashed, times = fresh("tid", docs), fresh("times", docs)
    rows = marked.where(F.col(id_col).isNotNull()).join(rooted, "fp").groupBy("root", id_col, "tid").agg(F.count("*").alias("times"))
    keep = rows.groupBy("root").agg(F.min(F.struct(id_col, "tid", "times")).alias("x")).select(F.col(f"x.`{id_col}`"), F.col("x.tid").alias(hashed), F.col("x.times").alias(times))
    # The list of kept rows grows with the table: by this hint it is never broadcast, and the plan is the same at every size.
    kept = docs.withColumn(hashed, F.xxhash64(utf8(text_col))).join(keep.hint("merge"), [id_col, hashed])
    kept = durable(kept.where(F.col(times) == 1).unionByName(kept.where(F.col(times) > 1).dropDuplicates([id_col, hashed])).select(docs.columns))
    release(marked)
    release(rooted)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def op3_simhash(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
