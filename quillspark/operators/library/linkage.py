"""Groups from weighted links beyond single linkage: a minimum spanning forest, its levels, and groups of bounded diameter.

The forest is found in rounds: every component takes its least link to another one, and
what the taken links connect becomes a component, so components halve at least. Cutting the
forest at a weight gives the groups of single linkage at that weight, whatever the weight.

Groups of bounded diameter come from the same forest. Each tree is walked round (a tour
of its links in both directions, ranked by pointer doubling), so every node's distance from
its tree's root follows from a running sum. A link stays if both its ends lie in one band of
half the diameter; what stays together has a path through its topmost node, each leg shorter
than half. Weights must be distances, such as the angle of a cosine, so that a path bounds the distance of its ends.

All tables are written between rounds; rounds grow with the logarithm of the nodes. Links of a node to
itself and links with nulls are left out; repeated links count with their least weight, and equal weights are
ordered by their ends. No links give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import connected_components
from quillspark.operators.durable import durable, release
from quillspark.operators.ranking import running_sum, shifted


def angles(links: DataFrame, cosine: str = "cosine") -> DataFrame:
    """Links with the angle of their cosine as weight ``w``."""
    return links.select("a", "b", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col(cosine)))).alias("w"))


def spanning_forest(links: DataFrame) -> DataFrame:
    """``(a, b, w)`` with a < b: a minimum spanning forest of links ``(a, b, w)``."""
    known = links.where("a is not null and b is not null and w is not null and a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    edges = durable(known.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")))
    taken: DataFrame | None = None
    while not edges.isEmpty():
        link = F.struct("w", "a", "b", "ca", "cb")
        sides = edges.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), link.alias("link")), F.struct(F.col("cb").alias("c"), link.alias("link")))).alias("x")).select("x.*")
        least = durable(sides.groupBy("c").agg(F.min("link").alias("link")).select("link.*").distinct())
        chosen = least.select("a", "b", "w")
        taken = chosen if taken is None else taken.unionByName(chosen)
        labels = connected_components(least.select("ca", "cb"), "ca", "cb")
        of = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_new"))
        joined = edges.join(of("ca"), "ca").join(of("cb"), "cb")  # a component with a link has taken one, so it has a label
        before, edges = edges, durable(joined.select("a", "b", "w", F.col("ca_new").alias("ca"), F.col("cb_new").alias("cb")).where("ca <> cb"))
        release(before)
    release(edges)
    return taken if taken is not None else known


def level_groups(forest: DataFrame, most: float) -> DataFrame:
    """``(node, component)`` of single linkage at weight ``most``, from the forest alone; nodes without such a link are their own component."""
    nodes = forest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    linked = connected_components(forest.where(F.col("w") <= most).select("a", "b"), "a", "b")
    return nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def depths(forest: DataFrame) -> DataFrame:
    """``(parent, node, w, depth)`` for every node but the roots: trees hang from their smallest node, depths add weights."""
    roots = connected_components(forest.select("a", "b"), "a", "b")
    both = forest.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("nb"), "w"), F.struct(F.col("b").alias("node"), F.col("a").alias("nb"), "w"))).alias("x")).select("x.*")
    # Coming from nb, the tour leaves a node to its next neighbour in order, after the last to the first; at the root it ends there.
    around = shifted(both, ["node"], [F.col("nb")], "nb", after="follow")
    first = both.groupBy("node").agg(F.min("nb").alias("first"))
    placed = around.join(first, "node").join(roots, "node")
    leave = F.coalesce("follow", F.when(F.col("node") != F.col("component"), F.col("first")))
    tour = durable(placed.select(F.col("nb").alias("u"), F.col("node").alias("v"), "w", "component", F.when(leave.isNotNull(), F.col("node")).alias("nu"), leave.alias("nv"), F.lit(1).cast("long").alias("left")))
    while not tour.where("nu is not null").isEmpty():
        ahead = tour.select(F.col("u").alias("nu"), F.col("v").alias("nv"), F.col("nu").alias("nnu"), F.col("nv").alias("nnv"), F.col("left").alias("more"))
        before, tour = tour, durable(tour.join(ahead, ["nu", "nv"], "left").select("u", "v", "w", "component", F.col("nnu").alias("nu"), F.col("nnv").alias("nv"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        release(before)
    back = tour.select(F.col("u").alias("v"), F.col("v").alias("u"), F.col("left").alias("back"))
    signed = tour.join(back, ["u", "v"]).withColumn("down", F.col("left") > F.col("back")).withColumn("step", F.when(F.col("down"), F.col("w")).otherwise(-F.col("w")))
    walked = running_sum(signed, ["component"], [F.col("left").desc()], "step", "depth")
    return walked.where("down").select(F.col("u").alias("parent"), F.col("v").alias("node"), "w", "depth")


def bounded_groups(links: DataFrame, diameter: float) -> DataFrame:
    """``(node, component)``: groups of linked nodes whose members lie within ``diameter`` of each other; the component is its smallest member."""
    hung = durable(depths(spanning_forest(links)))
    half = lambda d: F.floor(d / F.lit(diameter / 2))
    kept = hung.where(half(F.col("depth")) == half(F.greatest(F.lit(0.0), F.col("depth") - F.col("w")))).select(F.col("parent").alias("a"), F.col("node").alias("b"))
    nodes = hung.select(F.explode(F.array("parent", "node")).alias("node")).distinct()
    grouped = connected_components(kept, "a", "b")
    return nodes.join(grouped, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
