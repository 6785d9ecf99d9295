"""Connected components of links that stay distributed: alternating stars, each round a written table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import forget, join_spread, materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for each long that occurs in a link, the smallest node that links lead to.

    Null ends and links of a node to itself join nothing.  No links give no rows.  Each round hangs every node's
    larger, then its smaller neighbours on its smallest one; the rounds grow with the logarithm of the longest path,
    and a hub costs one row for each neighbour, never a pair of them, and its rows are spread over tasks.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = materialize(edges.distinct(), "links")
    mark = fingerprint(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = materialize(join_spread(both, least, ["u"], 2 * mark[0]).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        hung = join_spread(large, least, ["u"], mark[0]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        forget(large)
        forget(edges)
        edges, before, mark = new, mark, fingerprint(new)
        if mark == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def fingerprint(edges: DataFrame) -> tuple[int, int]:
    """The number of links and an order-free digest of them."""
    r = edges.agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("x")).first()
    return r["n"], r["x"]


class Labels:
    """Components of the local points 0 to n-1, whose roots are their smallest points."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, points: np.ndarray) -> np.ndarray:
        """The root of each point."""
        r = self.parent[points]
        while True:
            up = self.parent[r]
            if np.array_equal(up, r):
                self.parent[points] = r
                return r
            r = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Put the points a[k] and b[k] of each k into one component."""
        while len(a):
            x, y = self.roots(a), self.roots(b)
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """Links from each point to its component's first point."""
        every = np.arange(len(self.parent))
        of = self.roots(every)
        i = np.flatnonzero(of != every)
        return i, of[i]
