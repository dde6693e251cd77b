"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paychain.llm.common import materialize, with_group_min


class Forest:
    """Which of n points are connected."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[i] = r
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect a[k] with b[k] for each k."""
        while len(a):
            a, b = self.find(a), self.find(b)
            open_pairs = a != b
            a, b = a[open_pairs], b[open_pairs]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row (node, root) for each node of an edge; root is the smallest node of its component.

    Each round points every node at the smallest neighbour it knows, so chains shorten by
    half and hubs are only ever aggregated with map-side combine. Rounds end when the edge set
    stays the same. Self loops, repeated and null edges are ignored; no edges give no rows.
    """
    u, v = F.col("u"), F.col("v")
    now = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    seen = signature(now)
    while seen[0]:
        both = now.union(now.select(v, u))
        near = with_group_min(both, "u", "v", "m", "v")
        large = near.where(v > u).select(v.alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_group_min(large, "u", "v", "m", "v").select(F.explode(F.array(F.struct("u", "m"), F.struct(v.alias("u"), "m"))).alias("e"))
        nxt = materialize(small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).where(u != v).distinct())
        if (sign := signature(nxt)) == seen:
            break
        now, seen = nxt, sign
    # a star forest: every non-root has exactly one edge, to its root
    return now.select(u.alias("node"), v.alias("root")).union(now.select(v.alias("node"), v.alias("root")).distinct())
