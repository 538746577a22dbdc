"""Connected components by contraction.

In each round every node hooks to its smallest neighbour if that is smaller, pointers are followed to
their roots, and edges between roots remain; each round at least halves the nodes that have edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): each node of an edge and the smallest node that it reaches."""
    left = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    found: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("id"), F.least("u", "v").alias("p")), "parent")
        while True:  # follow pointers; each turn halves the depth
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("q"))
            jumped = written(parent.join(up, "p").select("id", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), "parent")
            parent = jumped.select("id", "p")
            if jumped.where("moved").isEmpty():
                break
        if found is None:
            found = parent.select("id", F.col("p").alias("component"))
        else:
            up = parent.select(F.col("id").alias("component"), "p")
            found = written(found.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component")), "found")
        of = lambda x: parent.select(F.col("id").alias(x), F.col("p").alias(f"p{x}"))
        left = written(left.join(of("u"), "u").join(of("v"), "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
    return found if found is not None else left.select(F.col("u").alias("id"), F.col("v").alias("component"))
