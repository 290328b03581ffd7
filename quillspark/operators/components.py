"""Connected components of an undirected graph by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.durable import durable, owns, release


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node that has an edge; the component is its smallest node.

    Each round links all larger neighbours of a node to its smallest neighbour
    (large star), then all smaller neighbours to the smallest (small star). The
    edge set shrinks towards one star per component in O(log n) rounds. Every
    round is two partial aggregations and two equi-joins, and is written out, so
    the lineage stays short. Self-loops and repeated edges are allowed; edges
    with a null end are ignored; an empty edge set gives an empty result. ``release``
    of the result deletes the written table it reads.
    """
    e = durable(
        edges.where(F.col(src) != F.col(dst))
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        done, e_old = seen, e
        e = durable(small)
        release(e_old)
        row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        seen = tuple(row)
        if seen == done or seen[0] == 0:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    return owns(out, e)
