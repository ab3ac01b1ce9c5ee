"""Connected components by distributed contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .job import anew, cut


def components(edges: DataFrame) -> DataFrame:
    """node and component (one of its nodes) of the undirected graph of edges (a, b).

    Each round, a node is represented by the first of itself and its neighbours
    in some order, and edges between nodes become edges between what represents
    them. So every round's graph is smaller than the one before, and edges are
    replaced, not kept. The nodes' own order makes a star one node at once; when
    a round leaves over three quarters of the edges, the next one takes the order
    of a new hash, by which a constant share of the nodes goes in any graph,
    whatever its shape. Last, the representatives are followed back from the
    smallest graph to the whole one. No neighbourhood is gathered, so a node may
    have any number of edges.
    """
    live = cut(edges.select("a", "b").where("a <> b").distinct())
    rounds: list[DataFrame] = []
    hashed, left = False, live.count()
    while left:
        order = lambda c: F.struct(*[F.xxhash64(F.lit(len(rounds)), c)] * hashed, F.col(c).alias("first"))  # noqa: B023, E731
        met = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = cut(met.groupBy("a").agg(F.least(order("a"), F.min(order("b")))["first"].alias("to")).select(F.col("a").alias("node"), "to"))
        rounds.append(first)
        of_a, of_b = (anew(first.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")), c) for c in "ab")
        moved = live.join(of_a, "a").join(of_b, "b").where("to_a <> to_b")
        live = cut(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        before, left = left, live.count()
        if left > 0.75 * before:
            hashed = not hashed
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where(F.lit(False))
    labels = rounds[-1].select("node", F.col("to").alias("component"))
    for earlier in reversed(rounds[:-1]):
        beyond = anew(labels.select(F.col("node").alias("to"), F.col("component").alias("beyond")), "to")
        labels = earlier.join(beyond, "to", "left").select("node", F.coalesce("beyond", "to").alias("component"))
    return cut(labels)
