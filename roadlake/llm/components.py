"""Connected components of an edge table by contraction: joins and aggregates that stay distributed.

A round hooks every node to the least of its neighbours and itself, follows the hooks to their roots by pointer jumping,
and replaces nodes by roots in the edges. The first round's order is that of the numbers, which ends stars around their
smallest node at once; later rounds have a random order of their own, so a node that has neighbours is its neighbourhood's
least with a chance of a half at most whatever the numbers are: rounds grow with the logarithm of the number of nodes. Every round
takes away a node of each component that has two, so the loop ends without a cap.

Each step is a written table: lost executors cost one step. A node with very many neighbours is one row of a partial
aggregate, and the joins have one row a key on one side, so that adaptive execution may split the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def placed(node: str, rounds: int) -> Column:
    """A node with its place in the order of a round."""
    place = F.xxhash64(node, F.lit(rounds)) if rounds else F.col(node)
    return F.struct(place.alias("place"), F.col(node).alias("n"))


def roots(hooks: DataFrame) -> DataFrame:
    """hooks (node, up) with every `up` the root that hooks lead to; the number of steps is the logarithm of the longest way."""
    while True:
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("further"))
        jumped = materialise(hooks.join(above, "up").select("node", F.col("further").alias("up"), (F.col("further") != F.col("up")).alias("moved")), "roots")
        discard(hooks)
        done = jumped.where("moved").isEmpty()
        hooks = jumped.select("node", "up")
        hooks._scratch = jumped._scratch
        if done:
            return hooks


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node that edges lead to.

    Nulls aren't nodes, nor are nodes whose only edges are loops; an empty table gives an empty one; repeated edges
    and loops change nothing.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = materialise(edges.union(edges.select("b", "a")).distinct(), "edges")
    contracted: list[DataFrame] = []
    while not contracted or not both.isEmpty():
        near = both.groupBy(F.col("a").alias("node")).agg(F.min(placed("b", len(contracted))).alias("near"))
        hooks = near.select("node", F.least("near", placed("node", len(contracted)))["n"].alias("up"))
        contracted.append(roots(materialise(hooks, "hooks")))
        up = contracted[-1]
        ends = both.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        fewer = materialise(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
        discard(both)
        both = fewer
    # from the last round to the first: a root of one round is a node of the next, unless nothing was left to join it to
    out = contracted[-1]
    for up in reversed(contracted[:-1]):
        further = out.select(F.col("node").alias("up"), F.col("up").alias("further"))
        out = up.join(further, "up", "left").select("node", F.coalesce("further", "up").alias("up"))
    out = materialise(out, "roots")
    smallest = out.groupBy("up").agg(F.min("node").alias("label"))
    labels = materialise(out.join(smallest, "up").select("node", "label"), "labels")
    discard(both, out, *contracted)
    return labels
