"""Connected components by frontier breadth-first search from many seeds at once.

The adjacency lists are hash-partitioned by node. Every node whose hash is the least of all within
two steps is a seed, so each component has at least one. All seeds expand together, one step a
round; where the frontiers of two seeds meet, an edge goes to the graph of seeds. That graph has at
most half as many nodes as the graph had non-isolated ones, and is solved in the same way until no
two seeds meet. Nothing but row counts reaches the driver. The neighbours of a node are
salted, so that a node linked to a third of all others is expanded by several tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import cut

SALTS = 8


def _order(node: str):
    return F.struct(F.xxhash64(node), F.col(node))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); ``component`` is one of its nodes.

    Edges are undirected; loops and repeated edges change nothing, edges with a null end are
    ignored. An empty input gives an empty result.
    """
    pairs = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())  # read several times below
    nodes = pairs.select(F.col("src").alias("node")).union(pairs.select("dst")).distinct()
    both = pairs.union(pairs.select("dst", "src")).where("src <> dst").distinct()
    links = cut(both.withColumn("salt", F.pmod(F.xxhash64("dst"), F.lit(SALTS))))  # each level of seeds reads its own links only
    if links.isEmpty():
        return nodes.select("node", F.col("node").alias("component"))
    own = lambda: F.struct(F.xxhash64("src").alias("h"), F.col("src").alias("n"))
    near = links.groupBy("src").agg(F.min(F.struct(F.xxhash64("dst").alias("h"), F.col("dst").alias("n"))).alias("least"))
    near = near.select(F.col("src").alias("via"), F.least("least", own()).alias("least"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("s"))
    around = links.join(near, (F.col("dst") == F.col("via")) & (F.pmod(F.xxhash64("src"), F.lit(SALTS)) == F.col("s"))).groupBy("src").agg(F.min("least").alias("least"))
    seeds = around.where(own() == F.col("least")).select(F.col("src").alias("node"))
    known = cut(seeds.select("node", F.col("node").alias("seed")))
    frontier, meetings = known, None
    while True:
        out = frontier.select("node", "seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
        reached = out.join(links, (F.col("node") == F.col("src")) & (out["salt"] == links["salt"])).select(F.col("dst").alias("node"), "seed").distinct()
        owned = known.select("node", F.col("seed").alias("owner"))
        step = cut(reached.join(owned, "node", "left"))
        fresh = step.where("owner is null").groupBy("node").agg(F.min("seed").alias("seed"))
        won = fresh.select("node", F.col("seed").alias("won"))
        met = step.join(won, "node", "left").select(F.col("seed").alias("src"), F.coalesce("owner", "won").alias("dst")).where("src <> dst").distinct()
        meetings = met if meetings is None else meetings.union(met)
        if fresh.isEmpty():
            break
        known, frontier = cut(known.union(fresh)), fresh
    meetings = cut(meetings.distinct())
    if meetings.isEmpty():
        merged = known.select("node", F.col("seed").alias("component"))
    else:
        over = components(meetings).select(F.col("node").alias("seed"), "component")
        merged = known.join(over, "seed", "left").select("node", F.coalesce("component", "seed").alias("component"))
    return nodes.join(merged, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def components_of_records(records: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """(node, component) where every record links its keys to one another; keys are compared as text."""
    first, rest = keys[0], keys[1:]
    links = [records.select(F.col(first).cast("string").alias("src"), F.col(k).cast("string").alias("dst")) for k in rest or [first]]
    edges = links[0]
    for link in links[1:]:
        edges = edges.union(link)
    return components(edges.distinct())
