"""Connected components by min-hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import settle


def merge_roots(links: DataFrame, rounds: int = 50) -> DataFrame | None:
    """``node, root`` for every node of ``links`` (a, b): the smallest node of its component.

    Each round every node hooks on its smallest neighbour, chains are shortened by pointer jumping until no
    pointer moves, and the links between the roots that remain are the next round's. A hub is only ever the
    target of a map-side combined ``min``, and every join has one row per key on one side. Rounds are
    checkpointed in the shared folder. Result None: no links.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = settle(links.where("a <> b").distinct())
    labels = None
    for _ in range(rounds):
        if links.isEmpty():
            return labels
        parents = settle(both(links).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
        for _ in range(rounds):
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
            jumped = settle(parents.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved")))
            parents = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        to = parents.select(F.col("node").alias("root"), F.col("root").alias("above"))
        if labels is None:
            labels = parents
        else:
            labels = settle(labels.join(to, "root", "left").select("node", F.coalesce("above", "root").alias("root")))
        left = links.join(parents.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(parents.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        links = settle(left.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    raise RuntimeError("the components did not settle")
