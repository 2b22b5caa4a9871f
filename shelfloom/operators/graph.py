"""Connected components of an edge table by alternating star contraction.

Every round links each node's larger neighbours to the smallest member of its
neighbourhood (large star), then each node's smaller neighbours likewise (small
star); the edges end as one star per component, its centre the smallest node.
Rounds grow with the logarithm of a component's size. A hub's edges meet in a
grouped minimum, which combines before the shuffle. The least neighbour of a hub
comes to its edges by broadcast and theirs stay where they are; hubs are nodes
with more than ``HUB`` edges and more than one in ``HUBS`` of all, so there are no
more than twice ``HUBS`` of them, and no node that is joined by shuffle has more.
Nothing is collected, and each round's table replaces the one before it.

Defined results: edges with a null end, edges of a node to itself and repeated
edges add nothing; no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfloom.runtime import discard, materialise


HUB = 256
HUBS = 10_000


def _met(edges: DataFrame, least: DataFrame, limit: int | None) -> DataFrame:
    """``edges`` (u, v) with ``m`` of ``least`` (u, m, n), whose ``n`` counts the edges of u; there are no hubs without a
    limit."""
    if limit is None:
        return edges.join(least.select("u", "m"), "u")
    hubs = F.broadcast(least.filter(F.col("n") > limit).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")))
    marked = edges.join(hubs, F.col("u") == F.col("hub"), "left")
    rest = marked.filter("hub is null").select("u", "v").join(least.filter(F.col("n") <= limit).select("u", "m"), "u")
    return rest.select("u", "v", "m").union(marked.filter("hub is not null").select("u", "v", F.col("hub_m").alias("m")))


def _round(edges: DataFrame, limit: int | None) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")  # its shuffle is made once for hubs and others
    large = _met(both, least, limit).filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.distinct()  # u > v from here on
    lower = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    small = _met(down, lower, limit).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.union(lower.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str, v: str) -> DataFrame:
    """(node, component) of every node on an edge between different nodes; the
    component is its smallest node. Edges with a null end are none."""
    ends = edges.select(F.col(u).alias("a"), F.col(v).alias("b")).filter("a <> b")
    ends = ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before = materialise(ends, "edges"), None
    while True:
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        # no node has more edges than there are
        after = materialise(_round(current, max(HUB, 2 * now[0] // HUBS) if now[0] > HUB else None), "edges")
        discard(current)
        current = after
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.union(current.select(F.col("v"), F.col("v"))).distinct()
