"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a partial aggregate and a join; the links stay distributed and are written to the shared folder
after each round.  A hot centre has one row per neighbour.  Its minimum is pre-aggregated, and it is handed out by
a sort-merge join that adaptive execution splits: both of its sides are plain shuffles, for the minima are
grouped by another expression than the one they are joined by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphemica.llm.buckets import discard, materialize


def _star(links: DataFrame, small: bool) -> DataFrame:
    """links: (u, v) with u > v.  Large star looks at both directions, small star at smaller neighbours only."""
    if not small:
        links = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = links.groupBy(F.struct("u").alias("k")).agg(F.min("v").alias("m")).select("k.u", F.least("m", "k.u").alias("m"))
    seen = links.join(least, "u")
    if small:  # every smaller neighbour and u itself point to the least
        out = seen.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:  # every larger neighbour points to the least
        out = seen.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u > v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns u, v of one type with an order); component is its least node.

    Nodes without links don't appear; self links and repeated links change nothing; null ends are ignored.  Each round's
    table goes when the next one is written; the last one stays.
    """
    now = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = materialize(now, "links")
    before = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        done, now = now, materialize(_star(_star(now, small=False), small=True), "links")
        discard(done)
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
