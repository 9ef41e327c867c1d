"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldseries.operators.materialize import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the least node that it reaches, for all nodes of the edges ``u``, ``v``.

    Alternating large-star and small-star steps: each node links its larger, then its
    smaller, neighbours to the least one around it. The number of steps grows with the
    logarithm of the longest path; a node with many neighbours is summed in parts (the
    least neighbour), never gathered. Each step is written to the shared folder. Loops
    and repeated edges are allowed; an empty table gives an empty table.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        # large star: larger neighbours of a node get the least node around it
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.where("u <> v").distinct())
        # small star: a node and its smaller neighbours get the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = materialize(small.distinct())
        moved = after.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(after, ["u", "v"], "left_anti").isEmpty()
        edges = after
        if moved:
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots)
