"""Checks of invariants, as tables of what breaks them and as errors.

Guards over groups (nodes, trajectories, edges) are DataFrames of the groups at
fault. Guards over all rows are metrics that are observed while the rows are
written or aggregated for their own purpose, and looked at after: they cost no
job. The functions that raise are for tables that nothing else reads yet.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class GuardError(ValueError):
    """Data that break an invariant."""


# What a measurement's provenance is told by.
PROVENANCE = ("adapter_name", "model", "quantization", "schema_version")


def watched(rows: DataFrame, metrics: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``rows``, and what is known of them once an action has read them."""
    seen = Observation(f"guard-{uuid.uuid4().hex}")
    return rows.observe(seen, *[m.alias(name) for name, m in metrics.items()]), seen


def seen_of(seen: Observation) -> dict:
    """The metrics; none if the optimizer found that no rows need be read."""
    try:
        return seen.get
    except Py4JJavaError:
        return {}


def embedding_metrics(column: str = "embedding") -> dict[str, Column]:
    return {"states": F.count(F.lit(1)), "embedded": F.count(column)}


def embeddings_verdict(seen: dict) -> bool:
    if 0 < seen.get("embedded", 0) < seen["states"]:
        raise GuardError(f"{seen['embedded']} of {seen['states']} states have an embedding")
    return seen.get("embedded", 0) > 0


def embeddings_uniform(states: DataFrame, column: str = "embedding") -> bool:
    """Whether states have embeddings; some with and some without raise."""
    return embeddings_verdict(states.agg(*[m.alias(n) for n, m in embedding_metrics(column).items()]).first().asDict())


def embedding_gaps(states: DataFrame, by: list[str], column: str = "embedding") -> DataFrame:
    """``by``, states, embedded: groups of which some have an embedding and
    some have none."""
    return states.groupBy(*by).agg(*[m.alias(n) for n, m in embedding_metrics(column).items()]).where("embedded > 0 and embedded < states")


def metadata_conflicts(states: DataFrame, column: str = "metadata_json") -> DataFrame:
    """node_id, n: nodes with more than one metadata value."""
    return states.groupBy("node_id").agg(F.count_distinct(F.coalesce(column, F.lit("null"))).alias("n")).where("n > 1")


def metadata_consistent(states: DataFrame, column: str = "metadata_json") -> None:
    """Every node has one metadata value."""
    bad = metadata_conflicts(states, column).orderBy("node_id").limit(5).collect()
    if bad:
        raise GuardError("nodes with differing metadata: " + ", ".join(str(r["node_id"]) for r in bad))


def provenance_metrics(metadata: str = "metadata", keys: tuple[str, ...] = PROVENANCE) -> dict[str, Column]:
    value = lambda k: F.try_element_at(metadata, F.lit(k))
    return {f"{end}_{k}": least(value(k)) for k in keys for end, least in (("lo", F.min), ("hi", F.max))}


def provenance_verdict(seen: dict, keys: tuple[str, ...] = PROVENANCE, force: bool = False) -> None:
    mixed = [k for k in keys if seen.get(f"lo_{k}") != seen.get(f"hi_{k}")]
    if mixed and not force:
        raise GuardError(f"mixed provenance: {mixed}")


def one_provenance(states: DataFrame, metadata: str = "metadata", keys: tuple[str, ...] = PROVENANCE, force: bool = False) -> None:
    """At most one value of each key over all states."""
    provenance_verdict(states.agg(*[m.alias(n) for n, m in provenance_metrics(metadata, keys).items()]).first().asDict(), keys, force)


def provenance_conflicts(states: DataFrame, by: list[str], metadata: str = "metadata", keys: tuple[str, ...] = PROVENANCE) -> DataFrame:
    """``by`` and the comma-joined ``mixed`` keys of groups with several values
    of one."""
    found = states.groupBy(*by).agg(*[m.alias(n) for n, m in provenance_metrics(metadata, keys).items()])
    mixed = F.array_compact(F.array(*[F.when(F.col(f"lo_{k}") != F.col(f"hi_{k}"), k) for k in keys]))
    return found.select(*by, F.array_join(mixed, ",").alias("mixed")).where("mixed <> ''")


def broken_trajectories(states: DataFrame) -> DataFrame:
    """trajectory_id, n, d, lo, hi of trajectories whose positions are not 0
    to n - 1."""
    each = states.groupBy("trajectory_id").agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.min("position").alias("lo"), F.max("position").alias("hi"))
    return each.where("n <> d or lo <> 0 or hi <> n - 1")


def trajectories_whole(states: DataFrame) -> None:
    """Positions of a trajectory are 0 to n - 1."""
    if not broken_trajectories(states).isEmpty():
        raise GuardError("positions are not 0, 1, ... of some trajectory")


def edge_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source_id, action_id, target_id, fault of edges that repeat, have a
    negative frequency or an unknown end; the first fault of these counts."""
    each = edges.groupBy("source_id", "action_id", "target_id").agg(F.count("*").alias("n"), F.min("frequency").alias("least"))
    for end in ("source", "target"):
        known = nodes.select(F.col("node_id").alias(f"{end}_id"), F.lit(True).alias(f"known_{end}")).distinct()
        each = each.join(known, f"{end}_id", "left")
    fault = F.when(F.col("n") > 1, "repeats").when(F.col("least") < 0, "negative").when(F.col("known_source").isNull() | F.col("known_target").isNull(), "unknown node")
    return each.select("source_id", "action_id", "target_id", fault.alias("fault")).where("fault is not null")


def edges_valid(nodes: DataFrame, edges: DataFrame) -> None:
    """Endpoints exist, keys are unique, frequencies are not negative."""
    bad = edge_faults(nodes, edges).first()
    if bad is not None:
        raise GuardError(f"an edge from {bad['source_id']} to {bad['target_id']}: {bad['fault']}")


def weights_ok(weights: Column) -> Column:
    """Whether a map of weights has none below 0 and a sum of 1."""
    values = F.map_values(weights)
    return ~F.exists(values, lambda w: w < 0) & (F.abs(F.aggregate(values, F.lit(0.0), lambda a, w: a + w) - 1) <= 1e-6)


def weights_valid(weights: dict[str, float]) -> None:
    if any(w < 0 for w in weights.values()) or abs(sum(weights.values()) - 1) > 1e-6:
        raise GuardError("weights must not be negative and sum to 1")


def keys_differ(a: Column, b: Column) -> Column:
    """The keys that only one of two maps has, in order, comma-joined."""
    x, y = F.map_keys(a), F.map_keys(b)
    return F.array_join(F.array_sort(F.concat(F.array_except(x, y), F.array_except(y, x))), ",")


def same_keys(a: dict, b: dict) -> None:
    if set(a) != set(b):
        raise GuardError(f"keys differ: {sorted(set(a) ^ set(b))}")
