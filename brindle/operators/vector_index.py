"""An exact index of the visits of each timestep, by inner product.

A timestep's visits are a tree of clusters. A node of more than ``leaf`` visits
is split by centres that are visits of its own, each visit going to the nearest
one; a child keeps its centre and its radius, the largest angle between the
centre and a member. Of unit vectors, angles obey the triangle inequality, so
no member of a cluster is nearer to a query than the angle to the centre less
the radius. A search finds the k-th best of the query's own leaf first and then
walks down from the root, leaving out every cluster whose bound on the inner
product is below that. Where so many clusters of a node are left that to send
the query to each would cost more than to compare it with all of the node's
members, it stops there. What is left is compared in full: results are exact,
ties by visit_seq included.

All steps deal with blocks: a split copies a node's at most ``FAN`` centres to
each ``BLOCK`` of its members, a search a node's members to each ``MET`` of the
queries that stop there. So a query is copied at most about once for each
``MET`` visits of its timestep, whatever the leaves' size and the bounds. Visits that can't be told apart
stay one leaf, of however many blocks. Where no timestep is larger than a leaf
its root is the leaf, and nothing is walked.

Defined cases: a timestep without visits gives its queries no rows; fewer than
k visits give as many; no visits, or no queries, no rows; vectors that are
missing, of several lengths or not of unit length are an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.store import cut_lineage

#: Rows of a block of either side, queries multiplied at once, children of a node.
BLOCK, STRIP, FAN = 8192, 64, 64
LEAF = 8192
#: Rows of a block of either side where queries meet visits, and how many
#: comparisons a copy of a query costs.
MET, COPY = 32768, 1000
TOLERANCE = 1e-3
#: What rounding may do to a bound; similarities have 9 digits.
SLACK = 1e-6


@dataclass
class Index:
    """``members``: visit_seq, timestep, embedding, node. ``tree``: timestep,
    parent, node, depth, centre, radius, n of every node but the roots."""

    members: DataFrame
    tree: DataFrame
    depth: int


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Embeddings as rows; one that is not of unit length, or of another
    length than the first, is an error."""
    vectors = column.combine_chunks()
    if len(vectors) == 0:
        return np.zeros((0, 0))
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if vectors.null_count or (sizes != sizes[0]).any():
        raise ValueError("embeddings are missing or differ in length")
    rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), int(sizes[0]))
    if (np.abs(np.sqrt((rows * rows).sum(1)) - 1) > TOLERANCE).any():
        raise ValueError("embedding is not of unit length")
    return rows


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors; of others too, as lengths are within TOLERANCE."""
    norm = lambda x: x / np.sqrt((x * x).sum(1, keepdims=True))
    return np.arccos(np.clip(norm(a) @ norm(b).T, -1, 1))


def _in_blocks(rows: DataFrame, sizes: DataFrame, n: str, seq: str, name: str, per: int = BLOCK) -> DataFrame:
    """``rows`` with the number of a block of about ``per`` of its node."""
    blocks = F.ceil(F.col(n) / per).cast("int")
    return rows.join(sizes, ["timestep", "node"]).withColumn(name, F.pmod(F.xxhash64(seq), blocks).cast("int")).drop(n)


def _for_blocks(rows: DataFrame, sizes: DataFrame, n: str, name: str, per: int = BLOCK) -> DataFrame:
    """``rows`` once for each block of their node's other side."""
    return rows.join(sizes, ["timestep", "node"]).withColumn(name, F.explode(F.sequence(F.lit(0), F.ceil(F.col(n) / per).cast("int") - 1))).drop(n)


def _sizes(rows: DataFrame, n: str) -> DataFrame:
    return cut_lineage(rows.groupBy("timestep", "node").agg(F.count("*").alias(n)), "sizes")


def _met(left: DataFrame, right: DataFrame, by: list[str], solve, schema: str) -> DataFrame:
    """``solve`` of the groups of either side; the right one's keys get names
    of their own, as both sides may come from one table."""
    other = right.select(*[F.col(c).alias(f"_{c}") if c in by else F.col(c) for c in right.columns])
    return left.groupBy(*by).cogroup(other.groupBy(*[f"_{c}" for c in by])).applyInArrow(solve, schema)


def _to_nearest(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of a block in the child whose centre is nearest."""
    right = right.sort_by("child")
    angle = _angles(matrix(left.column("embedding")), matrix(right.column("centre"))) if left.num_rows else np.zeros((0, 1))
    best = angle.argmin(1)
    nodes = np.array(right.column("child").to_pylist() or [""], object)[best]
    return pa.table({"visit_seq": left.column("visit_seq"), "timestep": left.column("timestep"), "embedding": left.column("embedding"), "node": pa.array(nodes, pa.string()), "angle": pa.array(angle[np.arange(len(best)), best] if len(best) else np.zeros(0))})


def _nearest_child(rows: DataFrame, children: DataFrame) -> DataFrame:
    """``rows`` (visit_seq, timestep, embedding, node), all of nodes that have
    ``children`` (timestep, node, child, centre), in the nearest child."""
    sizes = _sizes(rows, "n")
    dealt, centres = _in_blocks(rows, sizes, "n", "visit_seq", "block"), _for_blocks(children, sizes, "n", "block")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"visit_seq {kinds['visit_seq']}, timestep {kinds['timestep']}, embedding {kinds['embedding']}, node string, angle double"
    by = ["timestep", "node", "block"]
    return _met(dealt, centres, by, _to_nearest, schema)


def build(visits: DataFrame, leaf: int = LEAF) -> Index:
    """The index of ``visits`` (visit_seq, timestep, embedding). A level costs
    one shuffle of the vectors of nodes that are still too large."""
    now = visits.select(F.col("visit_seq").cast("long").alias("visit_seq"), "timestep", "embedding", F.lit("").alias("node"))
    kind = visits.schema["timestep"].dataType.simpleString()
    tree = visits.sparkSession.createDataFrame([], f"timestep {kind}, parent string, node string, depth int, centre array<double>, radius double, n long")
    done, depth = None, 0
    large = now.groupBy("timestep", "node").agg(F.count("*").alias("n")).where(F.col("n") > leaf)
    if large.isEmpty():
        return Index(now, tree, 0)
    large = cut_lineage(large, "large-nodes")
    while not large.isEmpty():
        key = ["timestep", "node"]
        small = now.join(large, key, "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = cut_lineage(now.join(large.select(*key), key, "left_semi"), "large")
        # About so many centres, by a hash of the visit: no node's visits are put in order.
        fan = F.least(F.lit(FAN), F.ceil(4 * F.col("n") / leaf))
        chosen = rows.join(large, key).where(F.pmod(F.xxhash64("visit_seq", F.lit(depth)), F.col("n")) < fan)
        order = Window.partitionBy(*key).orderBy("visit_seq")
        child = F.concat_ws(".", F.nullif("node", F.lit("")), F.row_number().over(order).cast("string"))
        children = cut_lineage(chosen.select(*key, child.alias("child"), F.col("embedding").cast("array<double>").alias("centre")), "centres")
        split = rows.join(children.select(*key).distinct(), key, "left_semi")
        moved = cut_lineage(_nearest_child(split, children), "moved")
        depth += 1
        level = moved.groupBy("timestep", "node").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
        named = children.select("timestep", F.col("node").alias("parent"), F.col("child").alias("node"), F.lit(depth).alias("depth"), "centre")
        level = cut_lineage(named.join(level, key).select("timestep", "parent", "node", "depth", "centre", "radius", "n"), "level")
        tree = tree.unionByName(level)
        # A node without a centre of its own waits for the next level; one whose visits all went one way is a leaf.
        waiting = rows.join(children.select(*key).distinct(), key, "left_anti")
        now = moved.drop("angle").unionByName(waiting)
        before = large.select("timestep", F.col("node").alias("parent"), F.col("n").alias("_all"))
        stuck = level.join(before, ["timestep", "parent"]).where("n = _all").select(*key)
        large = cut_lineage(level.where(F.col("n") > leaf).select(*key, "n").join(stuck, key, "left_anti").unionByName(large.join(children.select(*key).distinct(), key, "left_anti")), "large-nodes")
    members = now if done is None else done.unionByName(now)
    return Index(cut_lineage(members, "members"), cut_lineage(tree, "tree"), depth)


def _block_best(k: int, exclude_self: bool):
    """applyInArrow body: the best k visits of a block for each query of one."""

    def of(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_seq", "timestep", "visit_seq", "similarity"]
        kinds = [pa.int64(), left.schema.field("timestep").type, pa.int64(), pa.float64()]
        right = right.take(pc.sort_indices(right, [("visit_seq", "ascending")]))
        q, v = matrix(left.column("q")), matrix(right.column("embedding"))
        if not len(q) or not len(v):
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names=names)
        seq, visit, found = left.column("query_seq").to_numpy(), right.column("visit_seq").to_numpy(), []
        for at in range(0, len(q), STRIP):
            near = np.round(q[at : at + STRIP] @ v.T, 9)
            if exclude_self:
                near[seq[at : at + STRIP, None] == visit] = -np.inf
            # The k-th best and all above; of those equal to it, as visits are in order, the first.
            kth = -np.partition(-near, k - 1, 1)[:, k - 1, None] if k < near.shape[1] else np.full((len(near), 1), -np.inf)
            above, tied = near > kth, (near == kth) & (kth > -np.inf)
            row, col = np.nonzero(above | (tied & (np.cumsum(tied, 1) <= k - above.sum(1, keepdims=True))))
            found.append((seq[at + row], visit[col], near[row, col]))
        a, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
        step = pa.array([left.column("timestep")[0].as_py()] * len(a), kinds[1])
        return pa.Table.from_arrays([pa.array(a), step, pa.array(b), pa.array(c)], names=names)

    return of


def _in_leaves(pairs: DataFrame, members: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The best k of each leaf's blocks for ``pairs`` (query_seq, timestep, q,
    node) of queries and leaves."""
    sizes = cut_lineage(pairs.groupBy("timestep", "node").agg(F.count("*").alias("nq")).join(members.groupBy("timestep", "node").agg(F.count("*").alias("nv")), ["timestep", "node"]), "sizes")
    nq, nv = sizes.select("timestep", "node", "nq"), sizes.select("timestep", "node", "nv")
    q = _for_blocks(_in_blocks(pairs, nq, "nq", "query_seq", "qb", MET), nv, "nv", "vb", MET)
    v = _for_blocks(_in_blocks(members, nv, "nv", "visit_seq", "vb", MET), nq, "nq", "qb", MET)
    by = ["timestep", "node", "qb", "vb"]
    kind = members.schema["timestep"].dataType.simpleString()
    return _met(q, v, by, _block_best(k, exclude_self), f"query_seq bigint, timestep {kind}, visit_seq bigint, similarity double")


def _within_bound(left: pa.Table, right: pa.Table) -> pa.Table:
    """(query, child) whose bound is not below the query's k-th best; or the
    query and the node as a ``whole``, where that costs no more."""
    right = right.sort_by("child")
    if left.num_rows and right.num_rows:
        near = np.maximum(_angles(matrix(left.column("q")), matrix(right.column("centre"))) - right.column("radius").to_numpy(), 0)
        cos = np.cos(near)
        bound = cos * np.where(cos > 0, 1 + TOLERANCE, 1 - TOLERANCE) ** 2 + SLACK
        kept, n = bound >= left.column("least").to_numpy()[:, None], right.column("n").to_numpy()
        whole = -(-n.sum() // MET) * COPY + n.sum() <= kept.sum(1) * COPY + kept @ n
        row, col = np.nonzero(kept & ~whole[:, None])
        stopped = np.nonzero(whole)[0]
    else:
        row = col = stopped = np.zeros(0, int)
    taken = left.take(pa.array(np.concatenate([row, stopped]), pa.int64()))
    nodes = [*right.column("child").take(pa.array(col, pa.int64())).to_pylist(), *taken.column("node").slice(len(row)).to_pylist()]
    return pa.table({"query_seq": taken.column("query_seq"), "timestep": taken.column("timestep"), "q": taken.column("q"), "node": pa.array(nodes, pa.string()), "least": taken.column("least"), "whole": pa.array(np.arange(len(nodes)) >= len(row))})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_seq").orderBy(F.desc("similarity"), "visit_seq")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def reached(index: Index, queries: DataFrame, k: int, exclude_self: bool) -> tuple[DataFrame, DataFrame]:
    """What the queries' own leaves give, and the (query_seq, timestep, q,
    node, least) of further leaves, or whole nodes, that may hold something
    better."""
    children = index.tree.select("timestep", F.col("parent").alias("node"), F.col("node").alias("child"), "centre", "radius", "n")
    inner = cut_lineage(children.select("timestep", "node").distinct(), "inner")
    asked = queries.select(F.col("visit_seq").cast("long").alias("visit_seq"), "timestep", "embedding", F.lit("").alias("node"))
    here, home = asked, None
    for _ in range(index.depth):
        ended = here.join(inner, ["timestep", "node"], "left_anti")
        home = ended if home is None else home.unionByName(ended)
        here = _nearest_child(cut_lineage(here.join(inner, ["timestep", "node"], "left_semi"), "descent"), children.drop("radius", "n")).drop("angle")
    home = here if home is None else home.unionByName(here)
    home = cut_lineage(home.select(F.col("visit_seq").alias("query_seq"), "timestep", F.col("embedding").alias("q"), "node"), "home")
    own = cut_lineage(_best(_in_leaves(home, index.members, k, exclude_self), k), "own-leaf").drop("rank")
    least = own.groupBy("query_seq").agg(F.min("similarity").alias("least"), F.count("*").alias("n"))
    bound = home.join(least, "query_seq", "left").select("query_seq", "timestep", "q", "node", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(-2.0)).alias("least"))
    kind = queries.schema["timestep"].dataType.simpleString()
    vectors = queries.schema["embedding"].dataType.simpleString()
    key, walked = ["timestep", "node", "whole"], inner.withColumn("whole", F.lit(False))
    open_, ends = bound.withColumn("node", F.lit("")).withColumn("whole", F.lit(False)), None
    for _ in range(index.depth):
        ended = open_.join(walked, key, "left_anti")
        ends = ended if ends is None else ends.unionByName(ended)
        rows = open_.join(walked, key, "left_semi").drop("whole")
        sizes = _sizes(rows, "n")
        by = ["timestep", "node", "block"]
        dealt, centres = _in_blocks(rows, sizes, "n", "query_seq", "block"), _for_blocks(children.withColumnRenamed("n", "inside"), sizes, "n", "block").withColumnRenamed("inside", "n")
        open_ = cut_lineage(_met(dealt, centres, by, _within_bound, f"query_seq bigint, timestep {kind}, q {vectors}, node string, least double, whole boolean"), "open")
    ends = (open_ if ends is None else ends.unionByName(open_)).drop("whole")
    return own, cut_lineage(ends.join(home.select("query_seq", "node"), ["query_seq", "node"], "left_anti"), "further")


def search(index: Index, queries: DataFrame, k: int = 5, exclude_self: bool = False) -> DataFrame:
    """query_seq, timestep, visit_seq, similarity, rank of each query's k
    nearest visits of the same timestep; ties by visit_seq."""
    if index.depth == 0:
        pairs = queries.select(F.col("visit_seq").cast("long").alias("query_seq"), "timestep", F.col("embedding").alias("q"), F.lit("").alias("node"))
        return _best(_in_leaves(pairs, index.members, k, exclude_self), k)
    own, further = reached(index, queries, k, exclude_self)
    # Members by all nodes above them that are asked as wholes, and by their leaves.
    path = F.split("node", r"\.")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, 1, i), ".")))
    asked = cut_lineage(further.select("timestep", "node").distinct(), "asked")
    members = index.members.withColumn("node", F.explode(F.array_distinct(above))).join(asked, ["timestep", "node"], "left_semi")
    more = _in_leaves(further.drop("least"), members, k, exclude_self)
    # A whole node may have the query's own leaf in it.
    found = own.unionByName(more).groupBy("query_seq", "timestep", "visit_seq").agg(F.max("similarity").alias("similarity"))
    return _best(found, k)
