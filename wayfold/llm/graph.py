"""Distributed union-find over link tables, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b) undirected links -> (id, root): root is the smallest id that links reach; ids without a link are absent.

    Each round every node adopts its smallest neighbour and the links are contracted onto the adopted nodes, so
    the link table shrinks until none is left; the adoptions of all rounds are then composed. Nothing is
    collected: the driver only sees whether a round left links. Self links and null ends are ignored, repeated
    links count once, and an empty table gives an empty result.
    """
    kept = links.select("a", "b").where("a is not null and b is not null and a <> b")
    kept = scratch.save(kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    rounds = []
    while not kept.isEmpty():
        ends = kept.union(kept.select("b", "a"))
        adopt = scratch.save(ends.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")), "adopt")
        rounds.append(adopt)
        left = kept.join(adopt.select(F.col("id").alias("a"), F.col("root").alias("x")), "a")
        both = left.join(adopt.select(F.col("id").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
        shrunk = scratch.save(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        scratch.drop(kept)
        kept = shrunk
    if not rounds:
        return kept.select(F.col("a").alias("id"), F.col("b").alias("root"))
    whole = rounds[-1]
    for adopt in reversed(rounds[:-1]):
        later = whole.select(F.col("id").alias("root"), F.col("root").alias("top"))
        whole = adopt.join(later, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return scratch.save(whole, "components")
