"""Connected components by breadth-first search from many seeds at once.

Every vertex whose hash is smaller than its neighbours' is a seed. All seeds expand together, one hop
of the hash-partitioned adjacency list per round, until each vertex has a seed's label. Edges between
different labels are collisions; they form a smaller graph of labels (at most half as many vertices,
since seeds are never neighbours), which is solved the same way, and so on until nothing collides. Once that
graph has at most ``SMALL`` edges, which are counted as it is written, one task merges the labels at once.

Scale: no step collects anything. Rounds are short, because a path that descends in hash order is; the
smallest neighbour and the smallest label are combined map-side, and a vertex with a third of all
edges meets one row per vertex on the other side of its joins, which AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedlake.plans.scratch import Scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(vertex, component) for each vertex of an edge. Nulls and loops are ignored, repeats allowed.

    The component's name is one of its vertices. Vertices of no edge are left to the caller.
    """
    scratch = Scratch(edges.sparkSession, "components")
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u") != F.col("v"))
    return _solve(scratch, ends)


#: Edges of a graph of colliding labels that one task merges.
SMALL = 100_000


def _merge(collided: DataFrame) -> DataFrame:
    """(vertex, component) of a small graph (u, v): sets of labels joined in one task, named by their least label."""

    def join(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[str, str] = {}

        def top(x: str) -> str:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        for pdf in it:
            for u, v in zip(pdf["u"], pdf["v"]):
                up.setdefault(u, u)
                up.setdefault(v, v)
                a, b = sorted((top(u), top(v)))
                up[b] = a
        yield pd.DataFrame({"vertex": list(up), "component": [top(x) for x in up]}, dtype=object)

    return collided.coalesce(1).mapInPandas(join, "vertex string, component string")


def _solve(scratch: Scratch, ends: DataFrame) -> DataFrame:
    both = F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    adjacent = scratch.cut(ends.select(both).select("e.u", "e.v").distinct())
    key = lambda c: F.struct(F.xxhash64(c), F.col(c))
    seeds = adjacent.groupBy("u").agg(F.min(key("v")).alias("least")).where(key("u") < F.col("least")).select(F.col("u").alias("vertex"), F.col("u").alias("label"))
    layers = [scratch.cut(seeds)]
    while scratch.rows:
        labelled = reduce(DataFrame.unionByName, layers)
        hop = layers[-1].join(adjacent, F.col("vertex") == F.col("u")).groupBy(F.col("v").alias("vertex")).agg(F.min("label").alias("label"))
        layers.append(scratch.cut(hop.join(labelled.select("vertex"), "vertex", "left_anti")))
    labelled = reduce(DataFrame.unionByName, layers)
    left, right = (labelled.select(F.col("vertex").alias(x), F.col("label").alias(f"l{x}")) for x in ("u", "v"))
    collided = scratch.cut(adjacent.where("u < v").join(left, "u").join(right, "v").where("lu != lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct())
    scratch.drop(adjacent)
    if not scratch.rows:
        return labelled.select("vertex", F.col("label").alias("component"))
    inner = Scratch(scratch.spark, "collisions")
    merged = _merge(collided) if scratch.rows <= SMALL else _solve(inner, collided)
    out = labelled.join(merged.select(F.col("vertex").alias("label"), "component"), "label", "left")
    done = scratch.cut(out.select("vertex", F.coalesce("component", "label").alias("component")))
    inner.close()
    for df in (*layers, collided):
        scratch.drop(df)
    return done
