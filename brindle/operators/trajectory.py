"""Per-trajectory scores of per-state quantities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import uncertainty as U


def with_entropy(states: DataFrame) -> DataFrame:
    """``states`` with h, the distribution's entropy in bits (null without)."""
    return states.withColumn("h", F.when(F.col("distribution").isNotNull(), U.entropy_bits(F.col("distribution"))))


def populated_index(states: DataFrame) -> DataFrame:
    """idx: 0, 1, ... among the states that have a distribution."""
    order = Window.partitionBy("trajectory_id").orderBy("position")
    has = F.col("h").isNotNull()
    return states.withColumn("idx", F.when(has, F.sum(has.cast("int")).over(order) - 1))


def per_state(name: str, value: Column, how: str, default: float | None) -> Column:
    """mean, min or max of ``value`` over a trajectory's states; ``default``
    where no state has one."""
    if how not in ("mean", "min", "max"):
        raise ValueError(f"aggregation must be mean, min or max, not {how!r}")
    agg = {"mean": F.avg, "min": F.min, "max": F.max}[how](value)
    return (agg if default is None else F.coalesce(agg, F.lit(default))).alias(name)


def scores(states: DataFrame) -> DataFrame:
    """The distribution-based scores of every trajectory in one pass after
    one sort by position."""
    rows = populated_index(with_entropy(states))
    h, pos = F.col("h"), F.col("position")
    has = h.isNotNull()
    return rows.groupBy("trajectory_id").agg(
        per_state("mean_entropy", h, "mean", 0.0),
        F.coalesce(F.regr_slope(h, F.col("idx")), F.lit(0.0)).alias("entropy_plateau"),
        F.coalesce(F.regr_slope(h, pos), F.lit(0.0)).alias("entropy_slope_ts"),
        F.max_by(h, F.when(has, pos)).alias("terminal_entropy"),
        F.min_by(h, F.when(has, pos)).alias("initial_entropy"),
        F.max(h).alias("max_entropy"),
        F.count("*").alias("n_steps"),
        F.count(h).alias("n_positions"),
        per_state("mass_capture_mean", F.col("mass_capture"), "mean", 1.0),
        per_state("mass_capture_min", F.col("mass_capture"), "min", 1.0),
    )


def top_k_scores(states: DataFrame, k: int = 3, default: float | None = 0.0) -> DataFrame:
    """Scores of the top-K lists; ``default`` None keeps null (NaN in the
    reference's later analyses) for trajectories without lists."""
    t = F.col("top_k")
    have = F.size(t) > 0
    val = lambda c: F.when(have, c)
    return states.groupBy("trajectory_id").agg(
        per_state("mean_p_max", val(U.p_max(t)), "mean", default),
        per_state("min_p_max", val(U.p_max(t)), "min", default),
        per_state("mean_entropy_full", val(U.entropy_full(t)), "mean", default),
        per_state("mean_top_k_mass", val(U.top_k_mass(t, k)), "mean", default),
        per_state("min_top_k_mass", val(U.top_k_mass(t, k)), "min", default),
        per_state("mean_gap_top2", val(U.gap_top2(t)), "mean", default),
        per_state("min_gap_top2", val(U.gap_top2(t)), "min", default),
        per_state("mean_gap_top1_top_k", val(U.gap_top1_top_k(t, k)), "mean", default),
    )


def dynamics(states: DataFrame, space: list[str]) -> DataFrame:
    """How beliefs move between consecutive populated states: volatility,
    flips of the leading answer, entropy rises, margins, mass off the space."""
    rows = states.where(F.col("distribution").isNotNull()).select("trajectory_id", "position", "mass_capture", U.projected(F.col("distribution"), space).alias("p"))
    order = Window.partitionBy("trajectory_id").orderBy("position")
    entropy = U.entropy_of_list(F.col("p"))
    lead_of = F.array_position(F.col("p"), F.array_max("p"))
    rows = rows.withColumn("h", entropy).withColumn("top", lead_of)
    before = lambda c: F.lag(c).over(order)
    sorted_p = F.sort_array("p", asc=False)
    rows = rows.select(
        "*",
        U.js_divergence(before("p"), F.col("p")).alias("moved"),
        (before("top") != F.col("top")).cast("int").alias("flip"),
        ((F.col("h") - before("h")) > 1e-9).cast("int").alias("rise"),
        (F.get(sorted_p, F.lit(0)) - F.get(sorted_p, F.lit(1))).alias("margin"),
        (1 - F.col("mass_capture")).alias("off"),
        (F.sum(F.col("mass_capture").isNotNull().cast("int")).over(order) - 1).alias("k"),
    )
    steps = F.greatest(F.count("*") - 1, F.lit(1))
    return rows.groupBy("trajectory_id").agg(
        F.coalesce(F.avg("moved"), F.lit(0.0)).alias("volatility_mean"),
        F.coalesce(F.max("moved"), F.lit(0.0)).alias("volatility_max"),
        (F.coalesce(F.sum("flip"), F.lit(0)) / steps).alias("flip_rate"),
        (F.coalesce(F.sum("rise"), F.lit(0)) / steps).alias("mono_viol_rate"),
        F.min("margin").alias("margin_min"),
        F.avg("margin").alias("margin_mean"),
        F.coalesce(F.avg("off"), F.lit(0.0)).alias("offmass_mean"),
        F.coalesce(F.regr_slope(F.col("off"), F.when(F.col("off").isNotNull(), F.col("k"))), F.lit(0.0)).alias("offmass_slope"),
    )
