"""A persona's taste from past decisions: strengths of traits by a pairwise preference model (Bradley-Terry).

Within a group every kept photo was preferred to every rejected one. What is counted are
traits: a group adds kept times rejected for each two traits, from one count a group and
trait, so photos are never paired. Strengths then follow by iterated sums: a trait's wins over
what its strength and its rivals' would make it lose, with ``prior`` wins and losses
against a rival of strength 1, which keeps strengths finite and gives an unseen trait 1.

The score only orders what the gates let through. Null groups, traits and marks are left out; groups
without both kinds say nothing. No decisions give no strengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.durable import durable, release


def contests(decisions: DataFrame, group: str, trait: str, kept: Column, rejected: Column) -> DataFrame:
    """``(i, j, wins)``: how often trait i was kept where trait j was rejected in the same group."""
    known = decisions.where(F.col(group).isNotNull() & F.col(trait).isNotNull())
    counts = durable(known.groupBy(F.col(group).alias("g"), F.col(trait).alias("t")).agg(F.count_if(kept).alias("k"), F.count_if(rejected).alias("r")))
    won, lost = counts.where("k > 0").select("g", F.col("t").alias("i"), "k"), counts.where("r > 0").select("g", F.col("t").alias("j"), "r")
    return won.join(lost, "g").where("i <> j").groupBy("i", "j").agg(F.sum(F.col("k") * F.col("r")).alias("wins"))


def strengths(found: DataFrame, prior: float = 1.0, rounds: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """``(trait, strength)`` after as many rounds as it takes until no strength moves by more than a share of ``tolerance``, ``rounds`` at most."""
    sides = found.select("i", "j", "wins", F.lit(0).cast("long").alias("losses")).unionByName(found.select(F.col("j").alias("i"), F.col("i").alias("j"), F.lit(0).cast("long").alias("wins"), F.col("wins").alias("losses")))
    met = durable(sides.groupBy("i", "j").agg(F.sum("wins").alias("wins"), (F.sum("wins") + F.sum("losses")).alias("n")))
    wins = durable(met.groupBy("i").agg(F.sum("wins").alias("won")))
    now = durable(wins.select(F.col("i").alias("trait"), F.lit(1.0).alias("strength")))
    for _ in range(rounds):
        own, rival = now.select(F.col("trait").alias("i"), F.col("strength").alias("p")), now.select(F.col("trait").alias("j"), F.col("strength").alias("q"))
        load = met.join(own, "i").join(rival, "j").groupBy("i").agg(F.first("p").alias("p"), F.sum(F.col("n") / (F.col("p") + F.col("q"))).alias("load"))
        moved = load.join(wins, "i").select(F.col("i").alias("trait"), ((F.col("won") + prior) / (F.col("load") + 2 * prior / (F.col("p") + 1))).alias("strength"), "p")
        before, stepped = now, durable(moved)
        now = stepped.select("trait", "strength")
        change = stepped.agg(F.max(F.abs(F.log(F.col("strength") / F.col("p"))))).first()[0]
        release(before)
        if change is None or change <= tolerance:
            break
    return now


def scored(photos: DataFrame, taste: DataFrame, trait: str, out: str = "persona") -> DataFrame:
    """``photos`` with the chance that their trait is preferred to one of strength 1: 0.5 for an unseen or null trait."""
    named = taste.select(F.col("trait").alias(trait), F.col("strength").alias("_strength"))
    share = F.coalesce(F.col("_strength"), F.lit(1.0))
    return photos.join(named, trait, "left").withColumn(out, share / (share + 1)).drop("_strength")
