"""Connected components of a graph held in a DataFrame, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, released


def components(edges: DataFrame, rounds: int = 60, gather: bool = False) -> DataFrame:
    """(node, root) for every node of edges (a, b: long); root is the least node reachable.

    Each round, a node takes the least label among its neighbours, then the label that its
    label has (pointer jumping), so long chains shrink as fast as wide stars. Neighbours'
    labels meet by a minimum, which is combined before each shuffle: a hub costs a row per
    task. A round is written to the shared folder, so a lost executor costs one round. gather: a
    small graph's rounds go to few files."""
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    n = both.count() if gather else None  # edges both ways, and so nodes or labels at most
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), n)
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        # hooking: a tree's root learns the least label that any of its members sees
        met = cut(labels.join(seen.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("near")), n)
        # (written out, so that the join below deals out both of its sides and a large tree's nodes can be split)
        hooks = cut(met.groupBy("root").agg(F.min("near").alias("up")).where("up < root").withColumnRenamed("root", "old"), n)
        new = F.least("near", F.coalesce("up", "near"))
        moved = cut(met.join(hooks, met["root"] == hooks["old"], "left").select("node", new.alias("root"), (new < F.col("root")).alias("moved")), n)
        if moved.where("moved").isEmpty():
            return labels
        up = moved.select(F.col("node").alias("old"), F.col("root").alias("higher"))
        labels = cut(moved.join(up, moved["root"] == up["old"]).select("node", F.least("root", "higher").alias("root")), n)
        released(labels)
    raise RuntimeError(f"no fixed point after {rounds} rounds")
