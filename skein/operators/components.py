"""Connected components by alternating large-star and small-star steps.

Each step is a grouped minimum (combined on the map side, so a hub with a
third of all edges is summed up before the shuffle) and a join of the edges
with their node's minimum. The minima of hubs are broadcast, of which there can
only be so many; all others are met by an equi-join. Every round is written and
the one before it deleted; links never reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, drop_cut

#: A hub has more edges than this; and hubs are at most so many (16 bytes each), since ``n`` edges have ``2 n`` ends.
HUB, MOST_HUBS = 1_000, 1_000_000


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").distinct()


def _to_least(rows: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """Each row's v with the minimum of its u; least: (u, m, n)."""
    hubs = F.broadcast(least.where(F.col("n") > hub).select("u", "m"))
    met = rows.join(hubs, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    return met.unionByName(rest.select(F.col("v").alias("u"), F.col("m").alias("v")))


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return _to_least(both.where("v > u"), least, hub).where("u <> v")


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    return _distinct(_to_least(down, least, hub).unionByName(least.select("u", F.col("m").alias("v"))))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has an edge; component: the smallest node reachable.

    Edges with a null end are dropped; loops and repeated edges don't matter;
    no edges give no rows. Raises if ``most_rounds`` rounds don't end it (the
    number of rounds grows with the logarithm of the nodes).
    """
    now = _distinct(edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).dropna())
    now, before = cut(now), None
    for _ in range(most_rounds):
        print_of = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if print_of == before or not print_of[0]:
            # every node above its least points to it; the least nodes stand for themselves
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = print_of
        # a large star gives each edge twice at most
        hub = max(HUB, 4 * print_of[0] // MOST_HUBS)
        after = cut(_small_star(_large_star(now, hub), hub))
        drop_cut(now)
        now = after
    raise RuntimeError(f"no end after {most_rounds} rounds")
