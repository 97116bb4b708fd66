"""The score table of trajectories: components, ranks and the composite."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import graph, guards, knn, trajectory
from brindle.operators.ordered import rank_percentiles
from brindle.sources.store import cut_lineage

WEIGHTS = {"entropy_plateau": 1 / 3, "voi_flatness": 1 / 3, "distance_from_trajectory": 1 / 3}


def compute_signatures(states: DataFrame, steps: DataFrame, edges: DataFrame, queries: DataFrame, visits: DataFrame, weights: dict[str, float] | None = None, k: int = 5, exclude_self: bool = False, force: bool = False) -> DataFrame:
    """One row a trajectory of ``states``: the seven score columns as floats.

    composite is the weighted sum of the components' rank percentiles, ranked
    on doubles. ``steps`` and ``edges`` give voi_flatness, ``queries`` (with
    trajectory_id) and ``visits`` the distance; trajectories that lack either
    have 0 there. No states: no rows. States with a metadata map must have one
    provenance, unless ``force`` is set; embeddings are there for all or none."""
    weights = weights or WEIGHTS
    guards.weights_valid(weights)
    metrics = guards.embedding_metrics() if "embedding" in states.columns else {"states": F.count(F.lit(1))}
    if "metadata" in states.columns:
        metrics |= guards.provenance_metrics()
    states, seen = guards.watched(states, metrics)
    base = trajectory.scores(states).select("trajectory_id", "mean_entropy", "entropy_plateau", "mass_capture_mean", "mass_capture_min")
    parts = base.join(graph.voi_flatness(steps, edges), "trajectory_id", "left").join(knn.distance_from_trajectory(queries, visits, k=k, exclude_self=exclude_self), "trajectory_id", "left").fillna(0.0, ["voi_flatness", "distance_from_trajectory"])
    parts = cut_lineage(parts, "components")  # ranked and joined again; the states were seen meanwhile
    counts = guards.seen_of(seen)
    if counts.get("states"):
        guards.embeddings_verdict(counts)
        guards.provenance_verdict(counts, force=force)
    ranks = rank_percentiles(parts, "trajectory_id", {f"r_{c}": F.col(c) for c in weights})
    total = sum((F.col(f"r_{c}") * w for c, w in weights.items()), F.lit(0.0))
    names = ("entropy_plateau", "voi_flatness", "distance_from_trajectory", "mean_entropy", "mass_capture_mean", "mass_capture_min")
    joined = parts.join(ranks, "trajectory_id")
    return joined.select("trajectory_id", *[F.col(n).cast("float").alias(n) for n in names], total.cast("float").alias("composite"))
