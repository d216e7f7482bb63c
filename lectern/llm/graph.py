"""Connected components by repeated contraction, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import join_spread, settle


def node_key(col):
    """The key under which a BIGINT node appears in the result.

    XXH64 of one long is a bijection, so keys are as unique as the nodes, and their order is random:
    chains of increasing ids shrink as fast as any other graph.
    """
    return F.xxhash64(col)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node that has an edge; both are ``node_key`` values.

    Each round points a node at its smallest neighbour, or itself, and replaces every edge by the edge
    between the two pointers.  The node with the largest key is never pointed at, so the graph shrinks
    until no edge is left; the rounds' pointers are then followed to the roots.  Null ends, loops and
    repeated edges are ignored; no edge gives no row.
    """
    a, b = node_key(F.col(src).cast("long")), node_key(F.col(dst).cast("long"))
    left = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    left = settle(left.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct(), "edges")
    levels = []
    while edges_left := left.count():
        both = left.select(F.col("u").alias("node"), F.col("v").alias("to")).unionAll(left.select(F.col("v"), F.col("u")))
        step = both.groupBy("node").agg(F.min("to").alias("to"), F.count(F.lit(1)).alias("edges"))
        step = settle(step.select("node", F.least("node", "to").alias("root"), "edges"), "pointers")
        levels.append(step.select("node", "root"))
        s, t = step.select(F.col("node").alias("u"), F.col("root").alias("ru"), "edges"), step.select(F.col("node").alias("v"), F.col("root").alias("rv"), "edges")
        moved = join_spread(left, s, ["u"], "edges", F.xxhash64("v"), "inner", total=2 * edges_left).drop("edges")
        moved = join_spread(moved, t, ["v"], "edges", F.xxhash64("u"), "inner", total=2 * edges_left).filter(F.col("ru") != F.col("rv"))
        left = settle(moved.select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "edges")
    if not levels:
        return left.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = levels[0]
    for step in levels[1:]:
        up = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        sizes = settle(found.groupBy("root").agg(F.count(F.lit(1)).alias("nodes")).join(up, "root", "left"), "roots")
        found = settle(join_spread(found, sizes, ["root"], "nodes", F.col("node")).select("node", F.coalesce("higher", "root").alias("root")), "reached")
    return found
