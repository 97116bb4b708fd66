"""Structured Streaming over measurement rows (an extension: the batch
operators have no streaming counterpart elsewhere)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import uncertainty as U


def running_scores(states: DataFrame, event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Mean and largest entropy, states and least mass so far of each
    trajectory. With an event time, state of late trajectories is let go."""
    rows = states.withWatermark(event_time, delay) if event_time else states
    rows = rows.withColumn("h", F.when(F.col("distribution").isNotNull(), U.entropy_bits(F.col("distribution"))))
    return rows.groupBy("trajectory_id").agg(F.avg("h").alias("mean_entropy"), F.max("h").alias("max_entropy"), F.count("*").alias("n_states"), F.min("mass_capture").alias("mass_capture_min"))


def windowed_entropy(states: DataFrame, event_time: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Entropy of arriving states by tumbling windows of event time."""
    h = F.when(F.col("distribution").isNotNull(), U.entropy_bits(F.col("distribution")))
    return states.withWatermark(event_time, delay).groupBy(F.window(event_time, window)).agg(F.avg(h).alias("mean_entropy"), F.count("*").alias("n"))
