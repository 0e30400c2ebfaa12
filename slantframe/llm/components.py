"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slantframe.llm.scratch import Scratch


def merged_components(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of components (node, root) that further links (a, b) tie together.

    Only the roots that the links touch go through the rounds.
    """
    at = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
    between = links.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    tied = connected_components(between, scratch)
    moved = tied.select(F.col("node").alias("root"), F.col("root").alias("new"))
    out = scratch.save(roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")).unionAll(tied))
    scratch.drop(tied)
    return out


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of the links (a, b) that isn't its own root.

    Each round ties every node to the least node it sees, first through its
    larger neighbours, then through its smaller ones, until nothing changes;
    the rounds are logarithmic in the size of the largest component.  Minima
    are aggregated before the shuffle and rows are two numbers, so a node
    with very many links is no burden.  Rounds are written to the shared
    folder.
    """
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Larger neighbours of a root keep their link to it; all others are tied to the least.
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        done = scratch.save(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(edges)
        edges, last, state = done, state, _state(done)
        if state == last:
            break
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._scratch_path = edges._scratch_path
    return out


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
