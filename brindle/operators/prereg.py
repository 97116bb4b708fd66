"""Pre-registered predictions: threshold predicates over result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import uncertainty as U
from brindle.operators.ordered import quantiles

# The predictions' thresholds.
P1_AUC, P1_LOW = 0.60, 0.55
P2_DELTA = 0.05
P3_BAND = 0.10
P4_LOW = 0.55
P5A_MEDIAN, P5A_D = 0.02, 0.15
P5B_LIFT = (5.0, 15.0)
P6_FAILED = 0.05
E1_AUC = (0.55, 0.75)
E2_DELTA, E2_SPEARMAN = -0.05, 0.5
E3_AUC, E3_LIFT = 0.60, 5.0

#: Whose interval's lower end P4 asks to be below, and above, its threshold.
DISABLED, ENABLED = ("distance_from_trajectory", "entropy_plateau"), ("mean_entropy", "terminal_entropy")


def bottom_decile(rows: DataFrame, value: str, target: str = "target") -> DataFrame:
    """One row: n, k (of class 1), base rate, lift_pp and the one-sided 95 %
    lower bound lift_low_pp of the rows at or below the first decile."""
    keyed = rows.where(F.col(value).isNotNull()).withColumn("key", F.lit(0))
    low = F.col(value) <= F.col("_cut")
    out = keyed.join(quantiles(keyed, ["key"], value, {"_cut": 0.1}), "key").groupBy("key").agg(F.avg(target).alias("base"), F.sum(low.cast("int")).alias("n"), F.sum(F.when(low, F.col(target)).otherwise(0)).alias("k"))
    bound, _ = U.wilson(F.col("k"), F.col("n"), U.Z_ONE_SIDED)
    return out.select("n", "k", "base", ((F.col("k") / F.col("n") - F.col("base")) * 100).alias("lift_pp"), ((bound - F.col("base")) * 100).alias("lift_low_pp"))


def rules(areas: DataFrame, facts: DataFrame) -> DataFrame:
    """rule, measured, held. ``areas`` has score_column, sign_aware, direction
    and ci_low; ``facts`` one row: smoke, delta_median, cohen_d, lift_pp,
    lift_low_pp, failure_rate, spearman, gap_lift_pp. A rule about what neither
    has is not held; its measured value is null."""
    of = lambda c, score: F.max(F.when(F.col("score_column") == score, F.col(c)))
    names = ("mean_entropy", "terminal_entropy", "entropy_plateau", "distance_from_trajectory", "corrected_3", "mean_p_max", "mean_top_k_mass", "mean_gap_top2")
    wide = areas.groupBy(F.lit(0).alias("_key")).agg(*[of(c, n).alias(f"{c}_{n}") for n in names for c in ("sign_aware", "direction", "ci_low")])
    row = facts.withColumn("_key", F.lit(0)).join(wide, "_key", "left")
    auc, way, low = (lambda n: F.col(f"sign_aware_{n}")), (lambda n: F.col(f"direction_{n}")), (lambda n: F.col(f"ci_low_{n}"))
    me = auc("mean_entropy")
    every = lambda conditions: F.coalesce(*[F.when(~c, False) for c in conditions], F.lit(True))
    p4 = every([*[low(n) < P4_LOW for n in DISABLED], *[low(n) > P4_LOW for n in ENABLED]])
    told: list[tuple[str, Column, Column]] = [
        ("P1", me, (me > P1_AUC) & (low("mean_entropy") > P1_LOW) & (way("mean_entropy") == "greater")),
        ("P2", me - auc("corrected_3"), me - auc("corrected_3") >= P2_DELTA),
        ("P3", F.abs(me - F.col("smoke")), F.abs(me - F.col("smoke")) <= P3_BAND),
        ("P4", low("mean_entropy"), p4),
        ("P5a", F.col("delta_median"), (F.abs("delta_median") < P5A_MEDIAN) & (F.abs("cohen_d") < P5A_D)),
        ("P5b", F.col("lift_pp"), F.col("lift_pp").between(*P5B_LIFT) & (F.col("lift_low_pp") > 0)),
        ("P6", F.col("failure_rate"), F.col("failure_rate") < P6_FAILED),
        ("E1", auc("mean_p_max"), auc("mean_p_max").between(*E1_AUC)),
        ("E2", auc("mean_top_k_mass") - me, (auc("mean_top_k_mass") - me >= E2_DELTA) & (F.col("spearman") >= E2_SPEARMAN)),
        ("E3", auc("mean_gap_top2"), (auc("mean_gap_top2") >= E3_AUC) & (F.col("gap_lift_pp") >= E3_LIFT)),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), m.cast("double").alias("measured"), F.coalesce(h, F.lit(False)).alias("held")) for n, m, h in told])
    return row.select(F.inline(rows))
