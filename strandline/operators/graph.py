"""Connected components of a graph that never leaves the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import materialise


#: Neighbours from which a node is a hub, at least; and how many hubs there may be, which bounds what is broadcast.
HUB, HUBS = 256, 10_000


def _told(edges: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """(v, m): each neighbour v of a node u with the value m of u. ``least``: u, m, d (the number of neighbours).

    Hubs, nodes of more than ``hub`` neighbours, are told by broadcast, so that no task reads all neighbours of one; others by a shuffle.
    """
    hubs = F.broadcast(least.where(F.col("d") > hub).select("u", "m"))
    rest = edges.join(hubs, "u", "left_anti").join(least.where(F.col("d") <= hub).select("u", "m"), "u")
    return rest.select("v", "m").unionAll(edges.join(hubs, "u").select("v", "m"))


#: Nodes that a task holds at one time while it contracts edges; and edges up to which one task contracts a whole graph, of fewer nodes than that.
HELD, ALONE = 500_000, 200_000


def contracted(edges: DataFrame) -> DataFrame:
    """(a, b): edges that join the same nodes as ``edges``, of numbers or texts, contracted within each task: of nodes that are joined there, each has one edge to the smallest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict = {}

        def find(x):
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        def stars() -> pd.DataFrame:
            pairs = [(find(x), x) for x in up]
            return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"])

        for frame in frames:
            for a, b in zip(frame["a"].tolist(), frame["b"].tolist(), strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                x, y = find(a), find(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) >= HELD:
                yield stars()
                up.clear()
        if up:
            yield stars()

    return edges.select("a", "b").where("a <> b").mapInPandas(run, edges.select("a", "b").schema)


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(node, root) of all nodes of the ``edges`` (a, b), at most ``most`` rows where that is known: root is the smallest node of the component. Nulls and loops are no edges.

    A graph of at most ALONE edges is contracted in one task. Larger ones take large-star and small-star steps (Kiveris et al., 2014) until nothing changes; each round is
    written to the shared folder. A node's smallest neighbour is
    found with partial aggregation. At most HUBS nodes are hubs, as each has more than an even share of all edges; they are broadcast.
    """
    stars = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", most)
    mark = None
    while True:
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 2147483647)).first()
        if now == mark or not now[0]:
            break
        if now[0] <= ALONE:
            stars = materialise(contracted(stars.select(F.col("v").alias("a"), F.col("u").alias("b")).coalesce(1)).select(F.col("b").alias("u"), F.col("a").alias("v")), "stars", now[0])
            break
        mark = now
        hub = max(HUB, 2 * now[0] // HUBS)
        both = stars.unionAll(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d"), "least", 2 * now[0])
        large = materialise(_told(both.where("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars", 2 * now[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = _told(large, least, hub).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
        stars = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges", 3 * now[0])
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(stars.select("v", "v").distinct())
