"""Connected components by contraction, for edge lists of any size.

In each round every vertex learns the neighbour, itself included, of least random priority, and then takes the least of what it and its
neighbours have learned: so a hub and all around it agree in one round, whatever their priorities. The graph is contracted along
these pointers; at least a constant share of the vertices goes in each round, whatever the shape, so the number of rounds follows
the logarithm of the largest component. Each round's edges and pointers are written to the shared folder. Degrees are reduced by map-side
minima, and contracted hubs meet only one row on the pointer side, so that adaptive execution can split them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerframe.llm.shared import counted, written


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v: long) to one row for each vertex of an edge: vertex, root. Loops and repeated edges are allowed; no edges, no rows."""
    edges, left = counted(edges.select("u", "v").where("u <> v").distinct(), "links")
    levels: list[DataFrame] = []
    while left:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least, own = (F.struct(F.xxhash64(c, F.lit(len(levels))).alias("p"), F.col(c).alias("at")) for c in ("v", "u"))
        near = written(both.groupBy("u").agg(F.min(least).alias("m")).select("u", F.least("m", own).alias("m")), "least")
        heard = both.join(near.toDF("v", "m"), "v").select("u", "m").union(near)
        step = written(heard.groupBy("u").agg(F.min("m")["at"].alias("root")).withColumnRenamed("u", "vertex"), "roots")
        levels.append(step)
        moved = edges.join(step.toDF("u", "pu"), "u").join(step.toDF("v", "pv"), "v").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
        edges, left = counted(moved.where("u <> v").distinct(), "links")
    if not levels:
        return edges.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    out = levels[0]
    for step in levels[1:]:
        out = out.join(step.toDF("root", "next"), "root", "left").select("vertex", F.coalesce("next", "root").alias("root"))
    return out


def extended(roots: DataFrame, more: DataFrame) -> DataFrame:
    """`components` of the edges that roots (vertex, root; written) come of and of further ones (u, v): their contraction alone is searched."""
    for c in ("u", "v"):
        more = more.join(roots.toDF(f"at_{c}", f"root_{c}"), F.col(c) == F.col(f"at_{c}"), "left").withColumn(c, F.coalesce(f"root_{c}", c)).drop(f"at_{c}", f"root_{c}")
    last = components(more).toDF("root", "last")
    single = last.join(roots.select(F.col("root").alias("known")).distinct(), F.col("root") == F.col("known"), "left_anti")
    joined = roots.join(last, "root", "left").select("vertex", F.coalesce("last", "root").alias("root"))
    return joined.union(single.select(F.col("root").alias("vertex"), "last"))
