"""Connected components as DataFrame operations that no large neighbourhood holds up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sized, stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that isn't the least of its component, with the least; from undirected edges (a, b).

    Each node points to its least smaller neighbour; the other smaller ones are tied to
    that (hooking), and a node's pointer is moved to where its target points (shortcut).
    Pairs get smaller in every round, so the search ends, and it ends when every node has
    one pointer, to a node that has none.

    No step gathers the neighbours of a node: least neighbours and targets are aggregates,
    which tasks combine before they shuffle, however many nodes share a centre.  What
    changes in a round is joined to the pairs by broadcast if its files are small, else by
    a shuffle whose larger side may be split, as nothing after the join needs its keys.
    """
    state = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        least = stored(state.groupBy("a").agg(F.min("b").alias("b"), F.max("b").alias("other")), "least")
        torn = stored(least.where("b <> other").select("a", F.col("b").alias("to")), "torn")
        target = least.select("b").distinct()
        moves = stored(target.join(least.select(F.col("a").alias("b"), F.col("b").alias("to")), "b"), "moves")
        if torn.isEmpty() and moves.isEmpty():
            return least.select("a", "b")
        hooked = state.join(sized(torn), "a").where("b <> to").select(F.col("b").alias("a"), F.col("to").alias("b")).distinct()
        short = least.join(sized(moves), "b", "left").select("a", F.coalesce("to", "b").alias("b"))
        state = stored(short.unionByName(hooked), "edges")
