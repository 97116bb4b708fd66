"""Connected components by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Each step turns every edge into at most two and needs one aggregation and one
join on the node, both of which Spark can pre-aggregate or split where a node
is hot. Edges are written to the shared folder after each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.store import discard, materialize


def _toward_least(pairs: DataFrame, own: bool) -> DataFrame:
    """``pairs`` with m, the least neighbour of u (or u itself, if ``own``).
    The least ones are a table of their own, so that a join that meets a hot
    node may be split; an aggregate within the join's own plan could not."""
    least = F.least(F.min("v"), F.first("u")) if own else F.min("v")
    return pairs.join(materialize(pairs.groupBy("u").agg(least.alias("m")), "least"), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_least(both, True).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    met = _toward_least(down, False)
    ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return met.select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u > v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.col("v") % 1000003))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long) but the roots;
    root is the least node of the component. Loops and repeated edges do no
    harm; no edges: no rows. Rounds go on until nothing changes; their number
    is about the square of the logarithm of the nodes."""
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = _mark(now)
    while True:
        then = materialize(_small_star(_large_star(now)), "edges")
        discard(now)
        now, last, mark = then, mark, _mark(then)
        if mark == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
