"""Connected components of a graph given as edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task joins at a time: bounds its memory, not the result.
RUN = 1_000_000


def _stars(edges: DataFrame) -> DataFrame:
    """(node, root): each task joins the edges it has, so that its nodes point
    to the least node they reach there."""
    def run(batches):
        up: dict[int, int] = {}
        held = 0

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())],
                                              ["node", "root"])

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                up.setdefault(x, x)
                up.setdefault(y, y)
                p, q = root(x), root(y)
                if p != q:
                    up[max(p, q)] = min(p, q)
            held += b.num_rows
            if held > RUN:
                yield batch()
                up.clear()
                held = 0
        if up:
            yield batch()

    return edges.select("a", "b").mapInArrow(run, "node long, root long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; component is the least node.

    Each round the tasks turn their edges into stars, a node moves to the least
    of its roots, and what remains are edges between that and its other roots.
    The remaining graph has only roots as nodes, so it shrinks with every round;
    the rounds end when no edge is left. Every table is narrow, and a hot node is
    one row a task. Edges with a null end are dropped; an edge from a node to
    itself makes that node a component of its own.
    """
    from widen.session import checkpoint_dir

    checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where(
        "a IS NOT NULL AND b IS NOT NULL")
    place = None
    while True:
        stars = _stars(e).checkpoint()
        if stars.isEmpty():
            break
        step = stars.groupBy("node").agg(F.min("root").alias("to"))
        if place is None:
            place = step.withColumnRenamed("to", "component").checkpoint()
            step = place.withColumnRenamed("component", "to")
        else:
            place = (place.join(step, place["component"] == step["node"], "left")
                     .select(place["node"], F.coalesce("to", "component").alias("component")).checkpoint())
        e = (stars.join(step, "node").where("to <> root")
             .select(F.col("to").alias("a"), F.col("root").alias("b")).distinct().checkpoint())
    if place is None:
        return stars.select("node", F.col("root").alias("component"))
    return place
