"""Connected components of a link table that may be larger than any machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a long, b long), the
    component being its smallest node.

    Alternates two steps until nothing changes: every node ties its larger
    neighbours to the smallest node it knows, then its smaller neighbours.
    Minima are combined before the shuffle, and a node with very many links is
    only ever joined to the one row of its minimum. Each round is a written
    table. Links of a node with itself and repeated links do no harm."""
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = checkpoint(small.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
