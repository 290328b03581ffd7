"""Sharding by balanced label propagation over equal texts, with DataFrame functions only.

Documents are linked through hubs (here the hash of their text), so a group of any
size costs one row per document and no pairs. Shards hold equal numbers of rows:
shard j's quota is ``n // k`` rows, one more for the first ``n % k`` shards.

Unlinked documents have no preference; they fill the quotas at the end. Linked
documents start round robin and then, round by round, ask to move to a home of
their hub. A hub's homes are as many shards as its size needs, those that its members fill
furthest less the shard's price; its rows ask for them so as to fill all but the last. A shard that more members call home than its quota
holds becomes dearer each round, so hubs spread over the shards. Requests are granted as
far as they form swaps, longer cycles, or chains that end in free room, so no
shard ever exceeds its quota. A round is a grouping by hub and shard, one join of
documents with their hub's homes, and a salted ranking of the requests; only per-shard
totals reach the driver. Rounds are written out. They end when the equal pairs kept
together come within one in a hundred of what the quotas allow, or have not grown by one in
two hundred of that for ``PATIENCE`` rounds; the best round counts.

Null texts are linked as equal texts, empty ones likewise. Repeated ids are separate
rows. An empty table gives an empty result. Near ties between shards break by a hash
of hub and shard (``NOISE``).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.operators.durable import durable, release

ROWS_PER_BUCKET = 20_000
NOISE, PRICE_STEP = 0.1, 0.2
PATIENCE, LEAST_GAIN, ENOUGH = 4, 0.005, 0.99


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def numbered(df: DataFrame, keys: list[str], order: str, out: str, rows: int | None = None) -> DataFrame:
    """Number the rows of each key from 0 without gaps, with no task that sees more than a bucket of a key.

    Rows are ranked inside (key, bucket), buckets being hashes of ``order`` (which
    must be unique); the small table of bucket sizes gives each bucket its offset.
    ``rows`` is their number where it is known.
    """
    buckets = max(1, (df.count() if rows is None else rows) // ROWS_PER_BUCKET)
    salted = df.withColumn("_bucket", F.pmod(F.xxhash64(order), F.lit(buckets)))
    sizes = salted.groupBy(*keys, "_bucket").count()
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order)).cast("long") - 1
    return (
        salted.withColumn("_rank", rank).join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_rank")).drop("_bucket", "_before", "_rank")
    )


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (j < rows % shards) for j in range(shards)]


class Round(NamedTuple):
    """``pairs`` of rows of one hub, those ``kept`` in one shard before the round, rows ``moved`` by it."""

    pairs: float
    kept: float
    moved: int


def edges(placed: DataFrame) -> DataFrame:
    """One row ``(pairs, kept)`` for ``(hub, shard)`` rows: pairs of one hub, and those in one shard; the rest are cut edges."""
    spread = placed.groupBy("hub", "shard").agg(F.count("*").cast("double").alias("here"))
    hubs = spread.groupBy("hub").agg(F.sum("here").alias("total"), F.sum(F.expr("here * (here - 1) / 2")).alias("kept"))
    return hubs.agg(F.coalesce(F.sum(F.expr("total * (total - 1) / 2")), F.lit(0.0)).alias("pairs"), F.coalesce(F.sum("kept"), F.lit(0.0)).alias("kept"))


def _most(members: DataFrame, quota: int) -> tuple[float, float, float]:
    """All pairs of one hub, those that could be kept if each hub had its shards to itself, and the size of hub in which a row is on average."""
    q = float(max(1, quota))
    sizes = members.groupBy("hub").agg(F.count("*").cast("double").alias("n"))
    row = sizes.agg(F.sum(F.expr("n * (n - 1) / 2")), F.sum(F.expr(f"floor(n / {q}d) * {q * (q - 1) / 2}d + (n % {q}d) * (n % {q}d - 1) / 2")), F.sum(F.expr("n * n")) / F.sum("n")).first()
    return row[0] or 0.0, row[1] or 0.0, row[2] or 1.0


def _homes(current: DataFrame, quota: list[int], price: list[float], typical: float) -> DataFrame:
    """``(hub, total, kept, homes)``: the shards that suit each hub best, as many as its size needs.

    A hub larger than ``typical`` feels prices by as much less, since each of its rows has more to lose.
    """
    spread = current.groupBy("hub", "shard").agg(F.count("*").alias("here"))
    hubs = spread.groupBy("hub").agg(F.sum("here").alias("total"), F.map_from_entries(F.collect_list(F.struct("shard", "here"))).alias("spread"))
    score = f"coalesce(spread[j], 0) * need / total + {NOISE} * pmod(xxhash64(hub, j), 1048576) / 1048576 - price[j] * least(1.0d, {typical}d / total)"
    return (
        hubs.withColumn("price", F.array(*[F.lit(float(p)) for p in price]))
        .withColumn("need", F.expr(f"cast(least({len(quota)}, ceil(total / {max(1, max(quota))})) as int)"))
        .withColumn("ranked", F.expr(f"array_sort(transform(sequence(0, {len(quota) - 1}), j -> struct(-({score}) as cost, j as shard)))"))
        .select(
            "hub", "total", F.expr("aggregate(map_values(spread), 0.0d, (a, n) -> a + n * (n - 1.0d) / 2)").alias("kept"),
            F.expr("transform(slice(ranked, 1, need), s -> s.shard)").alias("homes"),
        )
    )


def propagate(members: DataFrame, quota: list[int]) -> tuple[DataFrame, list[Round]]:
    """Shards for linked rows, and what each round did. ``members``: ``(rid, hub, shard)`` within the quotas; returned in the same form."""
    shards, price, history, room = len(quota), [0.0] * len(quota), [], max(1, max(quota, default=0))
    held = {r[0]: r[1] for r in members.groupBy("shard").count().collect()}
    pairs, most, typical = _most(members, max(quota, default=0))
    best, best_kept, best_turn, current = members, -1.0, 0, members
    for turn in range(1_000_000):
        homes = durable(_homes(current, quota, price, typical))
        sums = homes.agg(F.coalesce(F.sum("kept"), F.lit(0.0)), *[F.coalesce(F.sum(F.expr(f"if(array_contains(homes, {j}), least({room}, total - (array_position(homes, {j}) - 1) * {room}), 0)")), F.lit(0)) for j in range(shards)]).first()
        if sums[0] > best_kept + LEAST_GAIN * most or turn == 0:
            if best is not members and best is not current:
                release(best)
            best, best_kept, best_turn = current, sums[0], turn
        if sums[0] >= ENOUGH * most or turn - best_turn >= PATIENCE:
            history.append(Round(pairs, sums[0], 0))
            release(homes)
            break
        price = [p + PRICE_STEP * (demand / max(1, q) - 1) for p, demand, q in zip(price, sums[1:], quota)]
        asked = durable(
            current.join(homes.select("hub", "total", "homes"), "hub").where(~F.expr("array_contains(homes, shard)"))
            .select("rid", "shard", F.expr(f"element_at(homes, cast(pmod(xxhash64(rid, {turn}), 1048576) / 1048576 * total / {room} as int) + 1)").alias("target"))
        )
        release(homes)
        wanted = {(r[0], r[1]): r[2] for r in asked.groupBy("shard", "target").count().collect()}
        granted = _grants(wanted, [q - held.get(j, 0) for j, q in enumerate(quota)])
        history.append(Round(pairs, sums[0], sum(granted.values())))
        if granted:
            limit = F.create_map(*[x for (i, j), n in sorted(granted.items()) for x in (F.lit(i * shards + j), F.lit(n).cast("long"))])
            moves = numbered(asked, ["shard", "target"], "rid", "nth", sum(wanted.values())).where(F.col("nth") < F.coalesce(limit[F.col("shard") * shards + F.col("target")], F.lit(0)))
            moved = durable(current.join(moves.select("rid", "target"), "rid", "left").select("rid", "hub", F.coalesce("target", "shard").alias("shard")))
            if current is not members and current is not best:
                release(current)
            current = moved
            for (i, j), n in granted.items():
                held[i], held[j] = held.get(i, 0) - n, held.get(j, 0) + n
        release(asked)
    if current is not best and current is not members:
        release(current)
    return best, history


def _grants(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many requests from each shard to each other are granted: swaps, longer cycles until none is left, then free room.

    What is left without cycles is taken from its ends backwards, so a row that moves into
    free room leaves its own place to those that want to go there.
    """
    left: list[dict[int, int]] = [{} for _ in room]
    out: dict[tuple[int, int], int] = {}

    def grant(i: int, j: int, n: int) -> None:
        left[i][j] -= n
        if not left[i][j]:
            del left[i][j]
        out[i, j] = out.get((i, j), 0) + n

    for (i, j), n in sorted(wanted.items()):
        if n:
            left[i][j] = n
    for i, j in sorted(wanted):
        if i < j and i in left[j] and j in left[i]:
            n = min(left[i][j], left[j][i])
            grant(i, j, n)
            grant(j, i, n)
    closed: list[int] = []  # shards from which no cycle goes out, those they lead to before them
    for start in range(len(room)):
        path = [] if start in closed else [start]
        while path:
            onward = next((j for j in left[path[-1]] if j not in closed), None)
            if onward is None:
                closed.append(path.pop())
            elif onward in path:
                cycle = [*path[path.index(onward) :], onward]
                n = min(left[i][j] for i, j in zip(cycle, cycle[1:]))
                for i, j in zip(cycle, cycle[1:]):
                    grant(i, j, n)
                path = path[: path.index(onward) + 1]
            else:
                path.append(onward)
    spare = list(room)
    for j in closed:
        for i in range(len(room)):
            n = min(spare[j], left[i].get(j, 0))
            if n > 0:
                grant(i, j, n)
                spare[j] -= n
                spare[i] += n
    return out


def shard_rows(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, size, text_crc32, shard, slot)`` per row: shard sizes differ by one row at most, slots have no gaps."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = durable(
        docs.select(
            F.col(id_col), (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
            F.unhex(F.sha2(raw, 256)).alias("hub"), F.monotonically_increasing_id().alias("rid"),
        )
    )
    rows = base.count()
    quota = quotas(rows, shards)
    groups = durable(base.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub"))  # written, so that a skewed join can split
    linked = numbered(base.join(groups, "hub").select("rid", "hub"), [], "rid", "nth") if rows else base.select("rid", "hub", F.lit(0).alias("nth"))
    start = durable(linked.select("rid", "hub", (F.col("nth") % shards).cast("int").alias("shard")))
    placed_links, _ = propagate(start, quota)
    settled = durable(placed_links.select("rid", "shard"))
    for done in (placed_links, start, groups):
        release(done)
    taken = {r[0]: r[1] for r in settled.groupBy("shard").count().collect()}
    bounds, total = [], 0
    for j in range(shards):
        total += quota[j] - taken.get(j, 0)
        bounds.append(total)
    free = numbered(base.join(settled, "rid", "left_anti").select("rid"), [], "rid", "nth")
    filled = free.withColumn("bounds", _longs(bounds)).select("rid", F.expr("size(filter(bounds, b -> b <= nth))").alias("shard"))
    placed = numbered(durable(settled.unionByName(filled)), ["shard"], "rid", "slot", rows)
    return base.join(placed, "rid").select(id_col, "size", "text_crc32", "shard", "slot")


def op1_sharding(docs: DataFrame) -> DataFrame:
    out = shard_rows(docs.select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
