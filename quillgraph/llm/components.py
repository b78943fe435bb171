"""Connected components of an edge table, by contraction.

Each round points every node at its neighbour of least hashed priority (or itself) and
replaces the ends of all edges by what they point at; a constant share of the nodes goes
in each round whatever the shape, and a star goes in one. Minima are combined before the
shuffle and a node with very many edges is only ever a skewed side of a join. Each round
is written to the shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written


def _rank(c: Column) -> Column:
    return F.struct(F.xxhash64(c).alias("h"), c.alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), in either direction, repeats and loops allowed.

    Returns (node, component): the least node reachable, for every node with an edge to
    another; nodes without one are absent."""
    e = edges.select("a", "b").where("a <> b")
    e = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    while not e.isEmpty():
        p = e.groupBy("a").agg(F.min(_rank(F.col("b"))).alias("m")).select("a", F.least(_rank(F.col("a")), F.col("m"))["v"].alias("p"))
        p = written(p, "parents")
        if labels is None:
            labels = p.withColumnsRenamed({"a": "node", "p": "label"})
        else:
            q = p.withColumnRenamed("a", "label")
            labels = written(labels.join(q, "label", "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        e = e.join(p.withColumnRenamed("p", "x"), "a").join(p.withColumnsRenamed({"a": "b", "p": "y"}), "b")
        e = written(e.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "edges")
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")
