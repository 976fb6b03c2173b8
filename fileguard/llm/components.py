"""Connected components of a list of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileguard.llm.common import forget, stored


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Links (u, v), u > v, moved to the smallest neighbour.

    Large star: every neighbour above a node is linked to the node's smallest neighbour (or itself). Small star: the node and
    its neighbours below are linked to the smallest of them. The minimum is a partial aggregate, and the rows of a node with
    many links are joined to it, so no node's neighbourhood is gathered in one place.
    """
    sides = edges.select("u", "v")
    if large:
        sides = sides.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    met = sides.join(least, "u")
    if large:
        moved = met.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        moved = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
    return moved.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node that can be reached.

    Links may point either way, repeat, or join a node to itself; a null end makes no link. Steps alternate until neither
    changes the links any more, each stored in the shared folder.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "components-links")
    mark = None
    while True:
        edges = stored(star(star(edges, large=True), large=False), "components-step")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(spark)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
