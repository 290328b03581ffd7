"""Filter interaction audit: what each filter removes in every order of application, from mask cells.

Every row gets a mask with a bit per filter it fails. Rows are counted per part and mask;
those cells, 32 a part for five filters, hold all that any order can ask. Within a part
the orders are visited by adjacent transpositions: each is the one before with two
neighbours swapped, so only those two steps are computed anew from the cells. Shapley
sums gather what each filter removes at every order of the walk.

Rows with equal text are found by their SHA-256 digest, counted before they are dealt: a
digest's rows meet only as one row per part, labels and task. All filters but the
one for copies depend on the text alone, so a digest has one mask besides that bit.

Null texts count as empty, as such equal to each other. A null id has no label, is no
smaller id, and has none below it. Rows that repeat an id are no copies of each other
unless a smaller id has their text. A label with several rows for an id counts if any of
them says 1. A null part is the empty string. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.durable import durable

WORD = r"[^\x20\x09-\x0D]+"
PARTS_AT_ONCE = 256

# The conditions of failure, over ``text`` and its array ``words``; E is ``is_copy``.
FILTERS = {
    "A": "size(words) < 50",
    "B": "100L * size(array_distinct(words)) < 65L * size(words)",
    "C": "100L * (length(text) - length(regexp_replace(text, '[A-Z]', ''))) > 5L * length(text)",
    "D": "text rlike '[#$%&*|]'",
}
COPY = "E"


def own_mask(filters: dict[str, str]) -> Column:
    """A bit per filter that a row fails, the first filter's being the lowest."""
    return F.expr(" + ".join(f"if({condition}, {1 << k}, 0)" for k, condition in enumerate(filters.values())))


def mask_cells(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``(part, mask, n, good, toxic)``: rows per part and set of failed filters; the highest bit marks copies of a smaller id's text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    rows = rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_mask(filters).alias("mask"))
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    marked = rows.join(known, "id", "left").fillna(0, ["good", "toxic"])
    kinds = ["digest", "part", "mask", "good", "toxic"]
    counted = marked.groupBy("id", *kinds).agg(F.count("*").alias("n"))  # the join has dealt rows by id already
    groups = counted.groupBy(*kinds).agg(
        F.sum("n").alias("n"), F.min("id").alias("least"), F.min_by("n", "id").alias("n_least"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_null")
    )
    groups = durable(groups)  # read twice; a few bytes a text
    firsts = groups.groupBy("digest").agg(F.min("least").alias("first"))
    placed = groups.join(firsts, "digest")
    own = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    bit = 1 << len(filters)
    both = F.array(F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - own).alias("n")))
    split = placed.select("part", "good", "toxic", F.explode(both).alias("cell"))
    n = F.col("cell.n")
    return split.where(n > 0).groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def adjacent_swaps(n: int) -> Iterator[tuple[tuple[int, ...], int | None]]:
    """Every order of 0 to n-1 once, each with the place whose item was swapped with the next one; none for the first."""
    order, left = list(range(n)), [True] * n  # all items look to the left
    yield tuple(order), None
    while True:
        # The largest item that looks at a smaller neighbour moves past it; all larger ones turn round.
        for item in range(n - 1, -1, -1):
            at = order.index(item)
            to = at - 1 if left[item] else at + 1
            if 0 <= to < n and order[to] < item:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        left[item + 1 :] = [not x for x in left[item + 1 :]]
        yield tuple(order), min(at, to)


class Walk:
    """All orders of the filters over the cells of some parts: arrays of ``(parts, masks)`` counts."""

    MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

    def __init__(self, n: int, rows: np.ndarray, good: np.ndarray, toxic: np.ndarray):
        self.n, self.rows, self.good, self.toxic = n, rows, good, toxic
        self.masks = np.arange(1 << n)

    def step(self, earlier: int, item: int) -> np.ndarray:
        """The measures of one filter after a set of earlier ones, for each part."""
        fails, gone = self.masks >> item & 1 == 1, self.masks & earlier != 0
        here = fails & ~gone
        alone = self.masks == 1 << item
        return np.stack([
            self.rows[:, ~fails & ~gone].sum(1), self.rows[:, here].sum(1), self.rows[:, fails & gone].sum(1), self.rows[:, alone].sum(1), self.good[:, here].sum(1), self.toxic[:, here].sum(1),
        ])

    def run(self) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
        """The orders as visited; measures by order, step, measure and part; Shapley sums by filter and part."""
        orders, seen, shapley = [], [], np.zeros((self.n, len(self.rows)), dtype=np.int64)
        steps: list[np.ndarray] = []
        for order, swapped in adjacent_swaps(self.n):
            places = range(self.n) if swapped is None else (swapped, swapped + 1)
            for k in places:
                now = self.step(sum(1 << i for i in order[:k]), order[k])
                steps[k : k + 1] = [now]
            for k, item in enumerate(order):
                shapley[item] += steps[k][1]
            orders.append(order)
            seen.append(np.stack(steps))
        return orders, np.stack(seen), shapley


RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """``RESULT`` rows for every part, order of the filters and step, from cells of :func:`mask_cells`."""
    n = len(letters)
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 2^n entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                yield walked(batch.slice(at, PARTS_AT_ONCE))

    def walked(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = np.zeros((3, batch.num_rows, 1 << n), dtype=np.int64)
        for k, found in enumerate(batch.column(1).to_pylist()):
            for cell in found:
                table[:, k, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
        orders, seen, shapley = Walk(n, *table).run()
        named = ["".join(letters[i] for i in order) for order in orders]
        place = np.arange(len(orders) * n * batch.num_rows)
        part, step = place % batch.num_rows, place // batch.num_rows % n
        sums = np.stack([shapley[list(order)] for order in orders])
        measures = [pa.array(seen[:, :, k].reshape(-1)) for k in range(len(Walk.MEASURES))]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(part)), pa.array(named).take(pa.array(place // (batch.num_rows * n))), pa.array((step + 1).astype(np.int32)), *measures, pa.array(sums.reshape(-1))],
            names=["part", "filter_order", "step", *Walk.MEASURES, "shapley"],
        )

    return by_part.select("part", "cells").mapInArrow(run, RESULT)


def op12_filters(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(mask_cells(documents, labels), "".join(FILTERS) + COPY)


_FAILS = "((f.mask >> (ascii(o.filter_order[s.step]) - 65)) & 1) = 1"
OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS copied FROM d),
m AS (SELECT doc_id, part,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * copied::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a JOIN x b ON a.c <> b.c JOIN x c ON c.c NOT IN (a.c, b.c) JOIN x d ON d.c NOT IN (a.c, b.c, c.c) JOIN x e ON e.c NOT IN (a.c, b.c, c.c, d.c)),
s AS (SELECT unnest(range(1, 6)) AS step),
e AS (SELECT filter_order, step, sum(1 << (ascii(filter_order[k]) - 65)) FILTER (k < step) AS earlier FROM o, s, (SELECT unnest(range(1, 6)) AS k) GROUP BY ALL),
r AS (SELECT f.part, o.filter_order, s.step::INT AS step, o.filter_order[s.step] AS letter,
    coalesce(sum(n) FILTER ((f.mask & coalesce(o.earlier, 0)::INT) = 0 AND NOT ({_FAILS})), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER ((f.mask & coalesce(o.earlier, 0)::INT) = 0 AND {_FAILS}), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER ((f.mask & coalesce(o.earlier, 0)::INT) <> 0 AND {_FAILS}), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (f.mask = (1 << (ascii(o.filter_order[s.step]) - 65))), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER ((f.mask & coalesce(o.earlier, 0)::INT) = 0 AND {_FAILS}), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER ((f.mask & coalesce(o.earlier, 0)::INT) = 0 AND {_FAILS}), 0)::BIGINT AS toxic_lost
  FROM f, e o, (SELECT unnest(range(1, 6)) AS step) s WHERE s.step = o.step GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM r
"""
