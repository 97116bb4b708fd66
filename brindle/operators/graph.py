"""Transition graph recovery and graph queries, as aggregations and joins.

A trajectory's rows (trajectory_id, position, node_id, action_id, outcome)
become nodes and edges. No list of outcomes is ever collected: entropies come
from counts by label. Every table below has a row a node, an action or an edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators import guards
from brindle.operators.ordered import quantiles
from brindle.sources.store import cut_lineage

UNCLASSIFIED, CONSENSUS, UNDERUTILIZED, RITUALIZED, RARE, MIDDLE = -1, 0, 1, 2, 3, 4

#: Default step weight of an edge by its class.
CLASS_WEIGHTS = {CONSENSUS: 1.0, UNDERUTILIZED: 2.0, RITUALIZED: 3.0, RARE: 5.0, MIDDLE: 2.0, UNCLASSIFIED: 1.0}


@dataclass(frozen=True)
class RecoveryConfig:
    min_count: int = 5
    drop_below: int = 1
    self_loops: bool = True
    high: float = 75.0
    low: float = 25.0

    def __post_init__(self) -> None:
        if self.min_count < 1 or self.drop_below < 1 or not 0 <= self.low <= self.high <= 100:
            raise ValueError("counts must be positive and 0 <= low <= high <= 100")


def visits(steps: DataFrame) -> DataFrame:
    """visit_seq 0, 1, ... in the order of trajectories and positions. Offsets
    of trajectories come from their lengths, summed over id ranges."""
    from brindle.operators.ordered import ordered_sums

    sizes = steps.groupBy("trajectory_id").agg(F.count("*").alias("n")).withColumn("key", F.lit(0))
    start = ordered_sums(sizes, ["key"], "trajectory_id", ["n"]).select("trajectory_id", "before_n")
    place = F.row_number().over(Window.partitionBy("trajectory_id").orderBy("position")) - 1
    return steps.withColumn("place", place).join(start, "trajectory_id").select((F.col("before_n") + F.col("place")).alias("visit_seq"), "trajectory_id", F.col("position").alias("timestep"), "node_id")


def adjacent(steps: DataFrame) -> DataFrame:
    """Each step with the node that follows it (null at the end)."""
    order = Window.partitionBy("trajectory_id").orderBy("position")
    return steps.withColumn("target_id", F.lead("node_id").over(order)).withColumnRenamed("node_id", "source_id")


def transitions(steps: DataFrame) -> DataFrame:
    return adjacent(steps).where("target_id is not null").groupBy("source_id", "action_id", "target_id").agg(F.count("*").alias("frequency"))


def label_entropy(rows: DataFrame, keys: list[str], label: str = "outcome") -> DataFrame:
    """keys, n_outcomes, entropy in bits of the labels; null labels skipped."""
    counts = rows.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("c"))
    # -sum c/n log2 c/n = log2 n - sum c log2 c / n
    return counts.groupBy(*keys).agg(F.sum("c").alias("n_outcomes"), F.greatest(F.lit(0.0), F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c")).alias("entropy"))


def _counted_entropy(label: str = "outcome") -> tuple[Column, Column]:
    """n_outcomes and entropy of rows with a label and its count ``c``."""
    known = F.when(F.col(label).isNotNull(), F.col("c"))
    n = F.sum(known)
    return n.alias("n_outcomes"), F.greatest(F.lit(0.0), F.log2(n) - F.sum(known * F.log2(known)) / n).alias("entropy")


#: What ``grouping_id`` says of the sets below: a bit for each column left out.
NODES, EDGES, TRAJECTORIES = 0b01101, 0b00001, 0b11110


def outcome_counts(steps: DataFrame) -> DataFrame:
    """Outcomes counted by node, by edge and by trajectory, as one table from
    one scan and one aggregate: ``set``, the keys, outcome, the count ``c`` and
    for trajectories the outcome they end with."""
    near = adjacent(steps).withColumn("last", F.col("outcome"))
    keys = ["source_id", "action_id", "target_id", "outcome", "trajectory_id"]
    sets = near.groupingSets([["source_id", "outcome"], ["source_id", "action_id", "target_id", "outcome"], ["trajectory_id"]], *keys)
    return cut_lineage(sets.agg(F.grouping_id().alias("set"), F.count("*").alias("c"), F.max("last").alias("last")), "outcomes")


def edge_class(voi: Column, rate: Column, voi_high: Column, voi_low: Column, rate_high: Column, rate_low: Column) -> Column:
    """The class of an action: information gain by how common it is."""
    return (
        F.when((voi >= voi_high) & (rate >= rate_high), CONSENSUS)
        .when((voi >= voi_high) & (rate <= rate_low), UNDERUTILIZED)
        .when((voi <= voi_low) & (rate >= rate_high), RITUALIZED)
        .when((voi <= voi_low) & (rate <= rate_low), RARE)
        .otherwise(MIDDLE)
        .cast("byte")
    )


def recover(steps: DataFrame, config: RecoveryConfig = RecoveryConfig()) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). nodes: node_id, visit_count, is_terminal, prior, level;
    edges: source_id, action_id, target_id, frequency, voi, consensus_rate,
    classification, posterior level. A step without a node has none in the
    graph. Steps with a metadata_json column must have one value of it a node."""
    if "metadata_json" in steps.columns:
        guards.metadata_consistent(steps)
    counted = outcome_counts(steps)
    ends = counted.where(F.col("set") == TRAJECTORIES).groupBy("last").agg(F.count("*").alias("c"))
    overall = ends.agg(_counted_entropy("last")[1].alias("h_global"))
    by_node = counted.where((F.col("set") == NODES) & F.col("source_id").isNotNull()).groupBy(F.col("source_id").alias("node_id"))
    node_h = by_node.agg(F.sum("c").alias("visit_count"), *_counted_entropy())

    local = F.coalesce(F.col("n_outcomes") >= config.min_count, F.lit(False))
    prior = F.when(local, F.col("entropy")).otherwise(F.coalesce("h_global", F.lit(0.0)))
    # One row is sent to all nodes.
    nodes = node_h.join(F.broadcast(overall)).select("node_id", "visit_count", prior.alias("prior"), F.when(local, "local").otherwise("global").alias("level"), local.alias("own"))
    nodes = cut_lineage(nodes, "nodes")  # read four times below

    moved = counted.where((F.col("set") == EDGES) & F.col("target_id").isNotNull())
    kept = moved.groupBy("source_id", "action_id", "target_id").agg(F.sum("c").alias("frequency"), *_counted_entropy()).where(F.col("frequency") >= config.drop_below)
    kept = kept if config.self_loops else kept.where("source_id <> target_id")
    target = nodes.select(F.col("node_id").alias("target_id"), F.col("prior").alias("target_h"), F.col("own").alias("target_own"))
    source = nodes.select(F.col("node_id").alias("source_id"), F.col("prior").alias("source_h"), "visit_count")
    wide = kept.join(target, "target_id").join(source, "source_id")
    by_edge = F.coalesce(F.col("n_outcomes") >= config.min_count, F.lit(False))
    wide = cut_lineage(wide, "edges")
    wide = wide.withColumn("h_t", F.when(by_edge, F.col("entropy")).otherwise(F.col("target_h"))).withColumn("posterior_level", F.when(by_edge, "local_via_edge").when(F.col("target_own"), "local").otherwise("global"))

    actions = wide.groupBy("source_id", "action_id").agg(
        (F.first("source_h") - F.sum(F.col("frequency") * F.col("h_t")) / F.sum("frequency")).alias("voi"),
        (F.sum("frequency") / F.first("visit_count")).alias("consensus_rate"),
    )
    actions = cut_lineage(actions.withColumn("voi", F.round("voi", 12)), "actions")
    at = {"high": config.high / 100, "low": config.low / 100}
    both = actions.select(F.inline(F.array(F.struct(F.lit("voi").alias("of"), F.col("voi").alias("x")), F.struct(F.lit("rate").alias("of"), F.col("consensus_rate").alias("x")))))
    found = quantiles(both, ["of"], "x", at)
    cuts = found.agg(*[F.max(F.when(F.col("of") == of, F.col(k))).alias(f"{of}_{k}") for of in ("voi", "rate") for k in at])
    classed = actions.join(F.broadcast(cuts)).select("source_id", "action_id", "voi", "consensus_rate", edge_class(F.col("voi"), F.col("consensus_rate"), F.col("voi_high"), F.col("voi_low"), F.col("rate_high"), F.col("rate_low")).alias("classification"))
    edges = wide.join(classed, ["source_id", "action_id"]).select("source_id", "action_id", "target_id", "frequency", "voi", "consensus_rate", "classification", "posterior_level")
    with_next = wide.select(F.col("source_id").alias("node_id")).distinct().withColumn("has_next", F.lit(True))
    nodes = nodes.join(with_next, "node_id", "left").select("node_id", "visit_count", F.col("has_next").isNull().alias("is_terminal"), "prior", "level")
    return nodes, edges


def has_node(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node_id) with ``known``: whether the graph has the node."""
    return wanted.join(nodes.select("node_id", F.lit(True).alias("known")).distinct(), "node_id", "left").fillna(False, ["known"])


def get_nodes(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The nodes that ``wanted`` (node_id) names; an unknown one is an error."""
    lost = wanted.join(nodes, "node_id", "left_anti").limit(5).collect()
    if lost:
        raise KeyError("unknown nodes: " + ", ".join(str(r["node_id"]) for r in lost))
    return nodes.join(wanted.select("node_id").distinct(), "node_id", "left_semi")


def out_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The edges that leave the nodes of ``wanted`` (node_id)."""
    return edges.join(wanted.select(F.col("node_id").alias("source_id")).distinct(), "source_id", "left_semi").select(*edges.columns)


def in_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The edges that lead to the nodes of ``wanted`` (node_id)."""
    return edges.join(wanted.select(F.col("node_id").alias("target_id")).distinct(), "target_id", "left_semi").select(*edges.columns)


def edges_by_class(edges: DataFrame, classification: int) -> DataFrame:
    if classification not in CLASS_WEIGHTS:
        raise ValueError(f"no edge class {classification}")
    return edges.where(F.col("classification") == classification)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, out_degree, in_degree; nodes without edges have zeros."""
    count = lambda side, name: edges.groupBy(F.col(side).alias("node_id")).agg(F.count("*").alias(name))
    out = nodes.select("node_id").join(count("source_id", "out_degree"), "node_id", "left").join(count("target_id", "in_degree"), "node_id", "left")
    return out.fillna(0, ["out_degree", "in_degree"])


def terminal_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("node_id").join(edges.select(F.col("source_id").alias("node_id")), "node_id", "left_anti")


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that nothing leads to; a self-loop leads to its node."""
    return nodes.select("node_id").join(edges.select(F.col("target_id").alias("node_id")), "node_id", "left_anti")


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    deg = degrees(nodes, edges).withColumn("key", F.lit(0))
    median = quantiles(deg, ["key"], "out_degree", {"median_out_degree": 0.5})
    out = deg.groupBy("key").agg(F.count("*").alias("n_nodes"), F.sum("out_degree").alias("n_edges"), F.avg("out_degree").alias("mean_out_degree"), F.max("out_degree").alias("max_out_degree"), F.avg((F.col("out_degree") == 0).cast("int")).alias("terminal_fraction"))
    return out.join(median, "key").drop("key")


def _path_sum() -> Column:
    """Sum of paths over arcs, null on overflow or where a term is null."""
    term = F.try_multiply("n_paths", F.col("parallel").cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.when(F.count(term) == F.count("*"), F.try_sum(term)).cast("decimal(38,0)")


def assembly_indices(nodes: DataFrame, edges: DataFrame, weights: dict[int, float] | None = None, max_rounds: int | None = None) -> DataFrame:
    """node_id, assembly_index_unweighted, assembly_index_weighted, n_paths.

    Shortest steps and least class weight from any root, and the number of
    shortest step paths, parallel edges counted each, as decimal(38, 0); null
    where there are more than that holds. Roots have 0, 0, 1;
    unreachable nodes null, null, 0. Rounds of frontier joins, each written to
    the shared folder; as many as the longest shortest path has steps."""
    weights = weights or CLASS_WEIGHTS
    if set(weights) - set(CLASS_WEIGHTS) or any(w < 0 for w in weights.values()) or (max_rounds is not None and max_rounds < 1):
        raise ValueError("weights are of edge classes and not negative, rounds are positive")
    weight = F.coalesce(*[F.when(F.col("classification") == k, F.lit(v)) for k, v in weights.items()], F.lit(1.0))
    arcs = cut_lineage(edges.groupBy("source_id", "target_id").agg(F.count("*").alias("parallel"), F.min(weight).alias("weight")), "arcs")
    start = roots(nodes, edges)
    if start.isEmpty():
        raise ValueError("the graph has no root")
    limit = max_rounds or 10**9
    seen = cut_lineage(start.select("node_id", F.lit(0).alias("steps"), F.lit(1).cast("decimal(38,0)").alias("n_paths")), "levels")
    frontier, depth = seen, 0
    while depth < limit:
        depth += 1
        reached = frontier.join(arcs, frontier.node_id == arcs.source_id).groupBy(F.col("target_id").alias("node_id")).agg(_path_sum().alias("n_paths"))
        fresh = cut_lineage(reached.join(seen.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(depth).alias("steps"), "n_paths"), "levels")
        if fresh.isEmpty():
            break
        seen, frontier = cut_lineage(seen.unionByName(fresh), "levels"), fresh
    best = cut_lineage(start.select("node_id", F.lit(0.0).alias("cost")), "costs")
    changed, turn = best, 0
    while turn < limit:
        turn += 1
        offers = changed.join(arcs, changed.node_id == arcs.source_id).groupBy(F.col("target_id").alias("node_id")).agg(F.min(F.col("cost") + F.col("weight")).alias("offer"))
        better = cut_lineage(offers.join(best, "node_id", "left").where("cost is null or offer < cost").select("node_id", F.col("offer").alias("cost")), "costs")
        if better.isEmpty():
            break
        best = cut_lineage(best.join(better.select("node_id"), "node_id", "left_anti").unionByName(better), "costs")
        changed = better
    out = nodes.select("node_id").join(seen, "node_id", "left").join(best, "node_id", "left")
    return out.select("node_id", F.col("steps").alias("assembly_index_unweighted"), F.col("cost").alias("assembly_index_weighted"), F.when(F.col("steps").isNull(), 0).otherwise(F.col("n_paths")).cast("decimal(38,0)").alias("n_paths"))


def voi_flatness(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean |VoI| over a trajectory's transitions; transitions that the graph
    lacks, or whose VoI is missing, count as the largest |VoI|; 0 without."""
    near = adjacent(steps)
    value = F.when(~F.isnan("voi"), F.abs("voi"))
    top = edges.agg(F.coalesce(F.max(value), F.lit(0.0)).alias("top")).withColumn("key", F.lit(0))
    looked = near.join(edges.select("source_id", "action_id", "target_id", value.alias("gain")), ["source_id", "action_id", "target_id"], "left").withColumn("key", F.lit(0)).join(F.broadcast(top), "key")
    moved = F.when(F.col("target_id").isNotNull(), F.coalesce("gain", "top"))
    return looked.groupBy("trajectory_id").agg(F.coalesce(F.avg(moved), F.lit(0.0)).alias("voi_flatness"))
