"""Connected components of an edge table, with no edge or label on the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Written


def _leads(edges: DataFrame, k: int) -> DataFrame:
    """(node, lead): of each node and its neighbours the one whose hash in round k is the smallest."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min_by("v", F.xxhash64("v", F.lit(k))).alias("v"))
    own = F.xxhash64("u", F.lit(k)) <= F.xxhash64("v", F.lit(k))
    return least.select(F.col("u").alias("node"), F.when(own, F.col("u")).otherwise(F.col("v")).alias("lead"))


def _contracted(edges: DataFrame, leads: DataFrame) -> DataFrame:
    """The edges between leads. Both sides of a join are plain tables, so that it can split a hub."""
    a, b = (leads.select(F.col("node").alias(end), F.col("lead").alias(name)) for end, name in (("u", "a"), ("v", "b")))
    met = edges.join(a, "u").select("a", "v").join(b, "v").where("a <> b")
    return met.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _followed(first: DataFrame, then: DataFrame) -> DataFrame:
    """(node, lead) with the lead's own lead, where it has one."""
    last = then.select(F.col("node").alias("lead"), F.col("lead").alias("top"))
    return first.join(last, "lead", "left").select("node", F.coalesce("top", "lead").alias("lead"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge.

    Contraction in a random order: each node goes over to the neighbour (or itself) whose hash
    is the smallest, and the edges between these go on to the next round. So nodes and edges
    shrink by a constant factor in each round, whatever the shape of the graph. Self-loops and
    null ends are ignored, and an empty edge table gives an empty result.
    """
    at = Written(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    rounds: list[Written] = []
    while at.df.limit(1).count():
        rounds.append(Written(_leads(at.df, len(rounds)), "leads"))
        after = Written(_contracted(at.df, rounds[-1].df), "edges")
        at.drop()
        at = after
    if not rounds:
        return at.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
    at.drop()
    named = Written(reduce(lambda then, first: _followed(first.df, then), reversed(rounds[:-1]), rounds[-1].df), "leads")
    least = named.df.groupBy("lead").agg(F.min("node").alias("root")).hint("rebalance")  # so that the join can split a large component
    out = Written(named.df.join(least, "lead").select("node", "root"), "components")
    for t in (named, *rounds):
        t.drop()
    return out.df
