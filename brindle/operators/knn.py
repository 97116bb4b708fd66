"""Exact nearest neighbours within a timestep, by inner product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import vector_index


def nearest(queries: DataFrame, visits: DataFrame, k: int = 5, exclude_self: bool = False, leaf: int = vector_index.LEAF) -> DataFrame:
    """query_seq, timestep, visit_seq, similarity, rank of each query's k
    nearest visits of the same timestep; ties by visit_seq. The visits are
    indexed for it: see ``vector_index``."""
    return vector_index.search(vector_index.build(visits, leaf), queries, k, exclude_self)


def distance_from_trajectory(queries: DataFrame, visits: DataFrame, trajectory: str = "trajectory_id", k: int = 5, exclude_self: bool = False) -> DataFrame:
    """For each trajectory the largest over its states of 1 - mean similarity
    of the k nearest visits; 0 where there is nothing to compare."""
    near = nearest(queries, visits, k, exclude_self).groupBy("query_seq").agg((1 - F.avg("similarity")).alias("distance"))
    states = queries.select(trajectory, F.col("visit_seq").alias("query_seq")).join(near, "query_seq", "left")
    return states.groupBy(trajectory).agg(F.coalesce(F.max("distance"), F.lit(0.0)).alias("distance_from_trajectory"))
