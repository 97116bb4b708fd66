"""Scores as deferral signals: areas, curves, operating points, calibration.

Input is long: one row a (score_column, unit) with ``score`` and a 0/1
``target``; further key columns (a stratum, a condition) may be added to
``keys``. All metrics come from distinct scores with their class counts.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.uncertainty import clipped, present
from brindle.operators import guards, resample
from brindle.operators.ordered import ordered_sums, quantiles, rank_percentile
from brindle.sources.store import cut_lineage

KEY = ["score_column"]
NAN = float("nan")


class EvaluationError(ValueError):
    """Input that an evaluation cannot be made from."""


def long_scores(scores: DataFrame, truth: DataFrame, columns: list[str], unit: str = "trajectory_id", target: str = "target", extra: tuple[str, ...] = ()) -> DataFrame:
    """Inner join of scores with labels, unpivoted to one row a score. An
    empty join, or labels of one class, is an error."""
    missing = [c for c in (unit, *columns) if c not in scores.columns] + [c for c in (unit, target) if c not in truth.columns]
    if missing:
        raise EvaluationError(f"columns not found: {missing}")
    require_both_classes(truth, target)
    # Written, as areas and totals both read it; the counts are seen meanwhile.
    found = scores.select(unit, *columns).join(truth.select(unit, F.col(target).alias("target"), *extra), unit)
    metrics = {"n": F.count(F.lit(1))} | {f"none_{i}": F.sum((~present(F.col(c).cast("double"))).cast("long")) for i, c in enumerate(columns)}
    found, seen = guards.watched(found, metrics)
    joined = cut_lineage(found, "joined")
    counts = guards.seen_of(seen)
    if not counts.get("n"):
        raise EvaluationError(f"no {unit} is in both the scores and the labels")
    dropped = {c: counts[f"none_{i}"] for i, c in enumerate(columns) if counts[f"none_{i}"]}
    if dropped:
        warnings.warn(f"of {counts['n']} rows these scores are missing and left out: {dropped}", stacklevel=2)
    pairs = F.array(*[F.struct(F.lit(c).alias("score_column"), F.col(c).cast("double").alias("score")) for c in columns])
    return joined.select(unit, "target", *extra, F.inline(pairs))


def require_both_classes(truth: DataFrame, target: str = "target") -> None:
    """Raise unless ``truth`` has positives and negatives: one aggregate."""
    seen = truth.agg(F.sum((F.col(target) == 1).cast("int")).alias("p"), F.sum((F.col(target) == 0).cast("int")).alias("n")).first()
    if not seen["p"] or not seen["n"]:
        raise EvaluationError(f"both classes are needed; positives {seen['p'] or 0}, negatives {seen['n'] or 0}")


def tie_groups(long: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct scores with pos, neg, and the sums over lesser scores."""
    kept = long.where(present(F.col("score")))
    groups = kept.groupBy(*keys, "score").agg(F.sum("target").cast("long").alias("pos"), F.sum(1 - F.col("target")).cast("long").alias("neg"))
    return ordered_sums(groups, keys, "score", ["pos", "neg"])


def class_totals(long: DataFrame, keys: list[str]) -> DataFrame:
    ok = present(F.col("score"))
    return long.groupBy(*keys).agg(
        F.sum(F.when(ok, F.col("target")).otherwise(0)).cast("long").alias("n_pos"),
        F.sum(F.when(ok, 1 - F.col("target")).otherwise(0)).cast("long").alias("n_neg"),
        F.sum((~ok).cast("long")).alias("n_dropped"),
    )


def deferral_auc(long: DataFrame, keys: list[str] = KEY, compute_ci: bool = False, n_bootstrap: int = 5000, seed: int = 42) -> DataFrame:
    """ROC area (raw, sign-aware, direction) and PR area for each key; keys
    whose scores are all missing have NaN. With ``compute_ci`` also 95 %
    bootstrap intervals of the raw area, of the sign-aware one (replicates
    turned in the point's direction, not clipped at 0.5) and of the PR area."""
    if compute_ci:
        points = cut_lineage(deferral_auc(long, keys), "areas")
        found = resample.intervals(resample.bootstrap_areas(long, keys, n_bootstrap, seed), points, keys)
        ends = [f"{c}_ci_{e}" for c in ("roc_auc", "roc_auc_sign_aware", "pr_auc") for e in ("low", "high")]
        out = points.join(found.select(*keys, *ends), keys, "left")
        return out.select(*points.columns, *[F.coalesce(c, F.lit(NAN)).alias(c) for c in ends])
    totals = class_totals(long, keys)
    terms = tie_groups(long, keys)
    above_pos, above_neg = F.col("total_pos") - F.col("before_pos"), F.col("total_neg") - F.col("before_neg")
    area = F.try_divide(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)), F.first(F.col("total_pos") * F.col("total_neg")))
    precision = F.try_divide(F.sum(F.col("pos") * above_pos / (above_pos + above_neg)), F.first("total_pos"))
    areas = terms.groupBy(*keys).agg(area.alias("roc_auc"), precision.alias("pr_auc"))
    found = totals.join(areas, keys, "left")
    nan = F.lit(NAN)
    roc = F.coalesce("roc_auc", nan)
    return found.select(
        *keys,
        roc.alias("roc_auc"),
        F.when(F.isnan(roc), nan).otherwise(F.greatest(roc, 1 - roc)).alias("roc_auc_sign_aware"),
        F.when(F.isnan(roc), F.lit(None).cast("string")).when(roc >= 0.5, "greater").otherwise("less").alias("direction"),
        F.coalesce("pr_auc", nan).alias("pr_auc"),
        "n_pos",
        "n_neg",
        "n_dropped",
    )


def auc_with_ci(long: DataFrame, keys: list[str] = KEY, n_bootstrap: int = 5000, seed: int = 42, bounded: list[str] | None = None) -> DataFrame:
    """keys, raw, sign_aware, direction, ci_low, ci_high, n_pos, n_neg: the
    interval is that of the area turned in the point's direction. With one
    class the areas are NaN and the direction is '?'. Where only the ends of
    some score columns are read, these are ``bounded``; the others' are null."""
    points = cut_lineage(deferral_auc(long, keys), "areas")
    asked = F.lit(True) if bounded is None else F.col("score_column").isin(bounded)
    found = resample.intervals(resample.bootstrap_areas(long.where(asked), keys, n_bootstrap, seed, precision=False), points, keys)
    end = lambda e: F.when(asked, F.coalesce(f"roc_auc_sign_aware_ci_{e}", F.lit(NAN))).alias(f"ci_{e}")
    return points.join(found, keys, "left").select(
        *keys, F.col("roc_auc").alias("raw"), F.col("roc_auc_sign_aware").alias("sign_aware"), F.coalesce("direction", F.lit("?")).alias("direction"), end("low"), end("high"), "n_pos", "n_neg"
    )


COMPONENTS = ("entropy_plateau", "voi_flatness", "distance_from_trajectory", "composite")


def component_table(scores: DataFrame, truth: DataFrame, target: str = "target", compute_ci: bool = True, n_bootstrap: int = 5000, seed: int = 42) -> DataFrame:
    """``deferral_auc`` of the three components and the composite."""
    return deferral_auc(long_scores(scores, truth, list(COMPONENTS), target=target), KEY, compute_ci, n_bootstrap, seed)


def grouped_comparison(scores: dict[str, DataFrame], truths: DataFrame | dict[str, DataFrame], name: str, score: str | dict[str, str] = "composite", mask: DataFrame | None = None, unit: str = "trajectory_id", target: str = "target", compute_ci: bool = True, n_bootstrap: int = 5000, seed: int = 42) -> DataFrame:
    """``deferral_auc`` of one score column of each named table, in one query
    with ``name`` as a key: of several models or conditions on the same labels,
    or of domains that have labels each (the same names are needed then).
    ``mask`` (unit) keeps some units only."""
    if isinstance(truths, dict) and set(truths) != set(scores):
        raise EvaluationError(f"scores and labels have different names: {sorted(scores)}, {sorted(truths)}")
    if isinstance(score, dict) and set(scores) - set(score):
        raise EvaluationError(f"no score column is named for {sorted(set(scores) - set(score))}")
    long = None
    for key, table in scores.items():
        own = truths[key] if isinstance(truths, dict) else truths
        own = own if mask is None else own.join(mask.select(unit).distinct(), unit, "left_semi")
        part = long_scores(table, own, [score[key] if isinstance(score, dict) else score], unit, target).withColumn(name, F.lit(key))
        long = part if long is None else long.unionByName(part)
    return deferral_auc(long, [name, "score_column"], compute_ci, n_bootstrap, seed)


#: The score that each condition is judged by.
CONDITION_SCORES = {"A": "deferral_signal", "B": "deferral_signal", "C": "composite"}


def _fractions(n: int) -> list[float]:
    return [k / n for k in range(n)]


def at_fractions(long: DataFrame, fractions: list[float], keys: list[str] = KEY) -> DataFrame:
    """For each key and deferral fraction: the threshold, and what is deferred
    (score at or above it) and kept."""
    if any(not 0 <= f <= 1 for f in fractions):
        raise EvaluationError("a deferral fraction must be in [0, 1]")
    kept = long.where(present(F.col("score")))
    names = {f"q{k}": 1 - f for k, f in enumerate(fractions)}
    cuts = quantiles(kept, keys, "score", names)
    groups = kept.groupBy(*keys, "score").agg(F.sum("target").alias("pos"), F.count("*").alias("n")).join(cuts, keys)
    sums = []
    for k in range(len(fractions)):
        over = F.col("score") >= F.col(f"q{k}")
        sums += [F.max(f"q{k}").alias(f"t{k}"), F.sum(F.when(over, F.col("n")).otherwise(0)).alias(f"d{k}"), F.sum(F.when(over, F.col("pos")).otherwise(0)).alias(f"p{k}")]
    wide = groups.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("pos").alias("pos"), *sums)
    rows = F.array(*[F.struct(F.lit(float(f)).alias("deferral_fraction"), F.col(f"t{k}").alias("threshold"), F.col(f"d{k}").alias("deferred"), F.col(f"p{k}").alias("deferred_pos")) for k, f in enumerate(fractions)])
    return wide.select(*keys, "total", "pos", F.inline(rows))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(NAN))


def deferral_curve(long: DataFrame, points: int = 20, keys: list[str] = KEY) -> DataFrame:
    found = at_fractions(long, _fractions(points), keys)
    kept = F.col("total") - F.col("deferred")
    return found.select(
        *keys, "threshold", "deferral_fraction", _ratio(F.col("pos") - F.col("deferred_pos"), kept).alias("residual_error_rate"), kept.alias("kept_count"), F.col("deferred").alias("deferred_count"), F.col("total").alias("total_count"), (F.col("pos") / F.col("total")).alias("error_rate_overall")
    )


def operating_points(long: DataFrame, fractions: list[float], keys: list[str] = KEY) -> DataFrame:
    found = at_fractions(long, fractions, keys)
    tp, neg, kept = F.col("deferred_pos"), F.col("total") - F.col("pos"), F.col("total") - F.col("deferred")
    tn = kept - (F.col("pos") - tp)
    return found.select(
        *keys, "deferral_fraction", "threshold", _ratio(tp, F.col("pos")).alias("sensitivity"), _ratio(tn, neg).alias("specificity"), _ratio(tp, F.col("deferred")).alias("ppv"), _ratio(tn, kept).alias("npv"), kept.alias("kept_n"), F.col("deferred").alias("deferred_n")
    )


def calibration_metrics(long: DataFrame, bins: int = 10, binning: str = "equal_count", keys: list[str] = KEY) -> DataFrame:
    """ECE, MCE and Brier score of scores in [0, 1]. equal_count: bins between
    the distinct quantiles; the last bin is closed; one distinct edge means no
    bins and an ECE of 0."""
    kept = long.where(present(F.col("score"))).withColumn("score", clipped(F.col("score")))
    if binning == "equal_width":
        edged = kept.withColumn("edges", F.array(*[F.lit(k / bins) for k in range(bins + 1)]))
    elif binning == "equal_count":
        names = [f"e{k}" for k in range(bins + 1)]
        cuts = quantiles(kept, keys, "score", {n: k / bins for k, n in enumerate(names)})
        edged = kept.join(cuts.select(*keys, F.array_sort(F.array_distinct(F.array(*names))).alias("edges")), keys)
    else:
        raise EvaluationError(f"binning must be equal_count or equal_width, not {binning!r}")
    place = F.least(F.size(F.filter("edges", lambda e: e <= F.col("score"))), F.size("edges") - 1)
    binned = edged.select(*keys, "score", "target", F.when(F.size("edges") > 1, place).alias("bin"))
    each = binned.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg("score").alias("s"), F.avg("target").alias("t"), F.sum((F.col("score") - F.col("target")) ** 2).alias("sq"))
    gap = F.when(F.col("bin").isNotNull(), F.abs(F.col("s") - F.col("t"))).otherwise(0.0)
    out = each.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), (F.sum("sq") / F.sum("n")).alias("brier_score"))
    return out.select(*keys, "ece", "mce", "brier_score")


def _curve(long: DataFrame, direction: str, keys: list[str]) -> tuple[DataFrame, int]:
    """(keys, s, fpr, tpr) of the ROC curve's corners by signed score, from the
    distinct scores and their neighbours' counts.

    A neighbour is found without one window over all scores: by the number of
    distinct scores before, which ``ordered_sums`` gives, a join on the next
    number."""
    if direction not in ("greater", "less"):
        raise EvaluationError(f"direction must be 'greater' or 'less', not {direction!r}")
    sign = 1 if direction == "greater" else -1
    kept = long.where(present(F.col("score"))).withColumn("score", F.col("score") * sign)
    groups = kept.groupBy(*keys, "score").agg(F.sum("target").cast("long").alias("pos"), F.sum(1 - F.col("target")).cast("long").alias("neg")).withColumn("one", F.lit(1).cast("long"))
    placed = cut_lineage(ordered_sums(groups, keys, "score", ["pos", "neg", "one"]), "curve")
    lower = placed.select(*keys, (F.col("before_one") + 1).alias("before_one"), F.col("pos").alias("next_pos"), F.col("neg").alias("next_neg"))
    met = placed.join(lower, [*keys, "before_one"], "left")
    first, last = F.col("before_one") == F.col("total_one") - 1, F.col("before_one") == 0
    kept_points = met.where(first | last | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    rate = lambda c: F.try_divide(F.col(f"total_{c}") - F.col(f"before_{c}"), F.col(f"total_{c}"))
    start = placed.select(*keys).distinct().select(*keys, F.lit(float("inf")).alias("s"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return kept_points.select(*keys, F.col("score").alias("s"), rate("neg").alias("fpr"), rate("pos").alias("tpr")).unionByName(start), sign


def _told(points: DataFrame, sign: int, keys: list[str], *more) -> DataFrame:
    return points.select(*keys, *more, (F.col("s") * sign).alias("threshold"), "fpr", "tpr", (1 - F.col("tpr")).alias("fnr"), (1 - F.col("fpr")).alias("tnr"))


def roc_table(long: DataFrame, direction: str = "greater", keys: list[str] = KEY) -> DataFrame:
    """Curve points (idx, threshold, fpr, tpr, fnr, tnr) from the strictest
    threshold on. The first threshold is infinite; points within a straight
    stretch are dropped."""
    points, sign = _curve(long, direction, keys)
    numbered = ordered_sums(points.withColumn("one", F.lit(1).cast("long")), keys, "s", ["one"])
    return _told(numbered, sign, keys, (F.col("total_one") - 1 - F.col("before_one")).cast("int").alias("idx"))


def _first_point(points: DataFrame, sign: int, keys: list[str], order) -> DataFrame:
    """The point of least ``order`` of each key, as one aggregate."""
    best = points.groupBy(*keys).agg(F.min_by(F.struct("s", "fpr", "tpr"), order).alias("p")).select(*keys, "p.*")
    return _told(best, sign, keys)


def threshold_at_fpr(long: DataFrame, target_fpr: float, direction: str = "greater", keys: list[str] = KEY) -> DataFrame:
    """The point of largest TPR whose FPR is at most ``target_fpr``."""
    if not 0 <= target_fpr <= 1:
        raise EvaluationError("target_fpr must be in [0, 1]")
    points, sign = _curve(long, direction, keys)
    return _first_point(points.where(F.col("fpr") <= target_fpr), sign, keys, F.struct(-F.col("tpr"), -F.col("s")))


def threshold_at_sensitivity(long: DataFrame, target: float, direction: str = "greater", keys: list[str] = KEY) -> DataFrame:
    """The point of least FPR whose TPR is at least ``target``."""
    if not 0 <= target <= 1:
        raise EvaluationError("the target sensitivity must be in [0, 1]")
    points, sign = _curve(long, direction, keys)
    return _first_point(points.where(F.col("tpr") >= target), sign, keys, F.struct("fpr", -F.col("s")))


def failure_table(long: DataFrame, n: int, unit: str = "trajectory_id") -> DataFrame:
    """The ``n`` units of highest score (ties by unit) with their rank
    percentile, label and whether the label is 1. No rows: no error."""
    ranked = rank_percentile(long.where(present(F.col("score"))), KEY, "score", "score_percentile")
    out = ranked.select(unit, "score", "score_percentile", "target", (F.col("target") == 1).alias("high_score_correct_outcome"))
    return out.orderBy(F.desc("score"), unit).limit(n)
