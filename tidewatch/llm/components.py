"""Connected components of a link table, and a block-wise union-find for use inside a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) for every node that a link names.

    links: a, b (bigint). Alternates the large-star and small-star operations until the table no
    longer changes; each is two shuffles of the link table, and hubs are pre-aggregated to their minimum.
    """
    pairs = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    for _ in range(most_rounds):
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        made = scratch.keep(small.where("u <> v").distinct())
        scratch.drop(pairs)
        pairs = made
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    stars = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.union(roots)


class UnionFind:
    """Over 0 .. n-1; merge() takes arrays and returns which of its links joined two parts."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        new = np.zeros(len(a), bool)
        for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                new[k] = True
        return new
