"""Evaluation of scores: areas, curves, calibration, cells with intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import uncertainty as U
from brindle.operators import evaluate as E
from brindle.operators import prereg, trajectory
from brindle.operators.ordered import quantiles
from brindle.plans.common import rounded, sql_rounded
from brindle.plans.scores import PER_TRAJECTORY, STEPS
from brindle.sources import fixtures as X
from brindle.sources.store import cut_lineage

QUERIES, ORACLES = {}, {}


def doc_long(spark, sf_dir, *extra):
    d = X.doc_scores(spark, sf_dir)
    return d.select("doc_id", "target", *extra, F.inline(F.array(F.struct(F.lit("n_chars").alias("score_column"), F.col("score").alias("score")))))


def auc_sql(source: str, keys: str = "score_column") -> str:
    """Areas of ``source`` (keys, score, target) in SQL."""
    return f"""rk AS (
  SELECT {keys}, score, target, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0::DOUBLE AS r FROM {source} WHERE score IS NOT NULL
), au AS (
  SELECT {keys}, sum(r) FILTER (target = 1) AS rs, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM rk GROUP BY {keys}
), roc AS (
  SELECT {keys}, p AS n_pos, n AS n_neg, (rs - p * (p + 1) / 2.0::DOUBLE) / (p * n) AS roc_auc FROM au
), tg AS (
  SELECT {keys}, score, count(*) FILTER (target = 1) AS tp, count(*) AS c FROM rk GROUP BY {keys}, score
), cu AS (
  SELECT {keys}, tp, sum(tp) OVER w AS ctp, sum(c) OVER w AS cc FROM tg WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC)
), pr AS (
  SELECT {keys}, sum(tp * (ctp / cc)) / sum(tp) AS pr_auc FROM cu GROUP BY {keys}
)"""


AUC_OUT = f"{sql_rounded('roc_auc', 'roc_auc')}, {sql_rounded('greatest(roc_auc, 1 - roc_auc)', 'roc_auc_sign_aware')}, CASE WHEN roc_auc >= 0.5 THEN 'greater' ELSE 'less' END AS direction, {sql_rounded('pr_auc', 'pr_auc')}, n_pos, n_neg"
AUC_COLS = [lambda: rounded("roc_auc"), lambda: rounded("roc_auc_sign_aware"), lambda: F.col("direction"), lambda: rounded("pr_auc"), lambda: F.col("n_pos"), lambda: F.col("n_neg")]
SCORES = ["mean_entropy", "entropy_plateau", "terminal_entropy", "initial_entropy", "max_entropy", "mass_capture_mean", "mass_capture_min"]
LONG = f"{PER_TRAJECTORY}, {X.TRUTH}, lg AS (" + " UNION ALL ".join(f"SELECT '{c}' AS score_column, trajectory_id, round({c}, 9) AS score, target FROM tr JOIN truth USING (trajectory_id)" for c in SCORES) + ")"


def trajectory_long(spark, sf_dir, columns=SCORES):
    found = trajectory.scores(X.states(spark, sf_dir))
    found = found.select("trajectory_id", *[F.round(c, 9).alias(c) for c in columns])
    return E.long_scores(found, X.truth(spark, sf_dir), columns)


def deferral_auc(spark, sf_dir):
    """join_scores_truth, f_dropnan, roc_auc, pr_auc of all score columns."""
    return E.deferral_auc(trajectory_long(spark, sf_dir)).select("score_column", *[c() for c in AUC_COLS], "n_dropped").orderBy("score_column")


QUERIES["deferral_auc"] = deferral_auc
ORACLES["deferral_auc"] = f"WITH {LONG}, {auc_sql('lg')} SELECT score_column, {AUC_OUT}, (SELECT count(*) FROM lg l WHERE l.score_column = roc.score_column AND score IS NULL) AS n_dropped FROM roc JOIN pr USING (score_column)"


def doc_auc(spark, sf_dir):
    """Areas of a score with many ties."""
    return E.deferral_auc(doc_long(spark, sf_dir)).select("score_column", *[c() for c in AUC_COLS])


QUERIES["roc_pr_auc_ties"] = doc_auc
ORACLES["roc_pr_auc_ties"] = f"WITH {X.DOC_SCORES}, lg AS (SELECT 'n_chars' AS score_column, score, target FROM scored), {auc_sql('lg')} SELECT score_column, {AUC_OUT} FROM roc JOIN pr USING (score_column)"


def stratified_auc(spark, sf_dir):
    """Areas by language; strata of one class and null strata are dropped."""
    keys = ["lang", "score_column"]
    long = doc_long(spark, sf_dir, "lang").where("lang is not null")
    return E.deferral_auc(long, keys).where("n_pos > 0 and n_neg > 0").select(*keys, *[c() for c in AUC_COLS])


QUERIES["stratified_auc"] = stratified_auc
ORACLES["stratified_auc"] = f"WITH {X.DOC_SCORES}, lg AS (SELECT lang, 'n_chars' AS score_column, score, target FROM scored WHERE lang IS NOT NULL), {auc_sql('lg', 'lang, score_column')} SELECT lang, score_column, {AUC_OUT} FROM roc JOIN pr USING (lang, score_column) WHERE n_pos > 0 AND n_neg > 0"


def condition_comparison(spark, sf_dir):
    """One score for each condition (source), unioned in one grouped query."""
    keys = ["source", "score_column"]
    long = doc_long(spark, sf_dir, "source").where("source is not null")
    return E.deferral_auc(long, keys).where("n_pos > 0 and n_neg > 0").select(*keys, *[c() for c in AUC_COLS])


QUERIES["condition_comparison"] = condition_comparison
ORACLES["condition_comparison"] = f"WITH {X.DOC_SCORES}, lg AS (SELECT source, 'n_chars' AS score_column, score, target FROM scored WHERE source IS NOT NULL), {auc_sql('lg', 'source, score_column')} SELECT source, score_column, {AUC_OUT} FROM roc JOIN pr USING (source, score_column) WHERE n_pos > 0 AND n_neg > 0"


def component_table(spark, sf_dir):
    """The fixed set of component columns."""
    return E.deferral_auc(trajectory_long(spark, sf_dir, ["entropy_plateau", "mass_capture_mean", "mass_capture_min", "mean_entropy"])).select("score_column", *[c() for c in AUC_COLS])


QUERIES["component_table"] = component_table
ORACLES["component_table"] = f"WITH {LONG}, {auc_sql('lg')} SELECT score_column, {AUC_OUT} FROM roc JOIN pr USING (score_column) WHERE score_column IN ('entropy_plateau', 'mass_capture_mean', 'mass_capture_min', 'mean_entropy')"


def entropy_summaries(spark, sf_dir):
    names = ["mean_entropy", "initial_entropy", "terminal_entropy", "max_entropy"]
    return E.deferral_auc(trajectory_long(spark, sf_dir, names)).select("score_column", *[c() for c in AUC_COLS])


QUERIES["entropy_summaries"] = entropy_summaries
ORACLES["entropy_summaries"] = f"WITH {LONG}, {auc_sql('lg')} SELECT score_column, {AUC_OUT} FROM roc JOIN pr USING (score_column) WHERE score_column IN ('mean_entropy', 'initial_entropy', 'terminal_entropy', 'max_entropy')"


def deferral_curve(spark, sf_dir):
    out = E.deferral_curve(doc_long(spark, sf_dir))
    return out.select("score_column", rounded("deferral_fraction"), rounded("threshold"), rounded(F.nanvl("residual_error_rate", F.lit(-1.0)), "residual_error_rate"), "kept_count", "deferred_count", "total_count", rounded("error_rate_overall"))


QUERIES["deferral_curve"] = deferral_curve
ORACLES["deferral_curve"] = f"""WITH {X.DOC_SCORES}, fr AS (SELECT k / 20.0::DOUBLE AS f FROM range(20) t(k)),
th AS (SELECT f, (SELECT quantile_cont(score, 1 - f) FROM scored) AS t FROM fr),
ag AS (SELECT f, t, count(*) FILTER (score < t) AS kept, count(*) FILTER (score >= t) AS deferred, count(*) AS total, avg(target) FILTER (score < t) AS res, avg(target) AS base FROM th, scored GROUP BY f, t)
SELECT 'n_chars' AS score_column, {sql_rounded('f', 'deferral_fraction')}, {sql_rounded('t', 'threshold')}, {sql_rounded('coalesce(res, -1)', 'residual_error_rate')}, kept AS kept_count, deferred AS deferred_count, total AS total_count, {sql_rounded('base', 'error_rate_overall')} FROM ag"""
ORACLES["deferral_curve"] = ORACLES["deferral_curve"].replace("(SELECT quantile_cont(score, 1 - f) FROM scored) AS t FROM fr", "list_extract((SELECT quantile_cont(score, [" + ", ".join(str(1 - k / 20) for k in range(20)) + "]) FROM scored), CAST(round(f * 20) AS INT) + 1) AS t FROM fr")

POINTS = [0.0, 0.1, 0.25, 0.5, 0.9]


def operating_points(spark, sf_dir):
    out = E.operating_points(doc_long(spark, sf_dir), POINTS)
    return out.select("score_column", rounded("deferral_fraction"), rounded("threshold"), *[rounded(F.nanvl(c, F.lit(-1.0)), c) for c in ("sensitivity", "specificity", "ppv", "npv")], "kept_n", "deferred_n")


QUERIES["operating_points"] = operating_points
ORACLES["operating_points"] = f"""WITH {X.DOC_SCORES}, th AS (SELECT unnest({POINTS}::DOUBLE[]) AS f, unnest((SELECT quantile_cont(score, {[float(1 - p) for p in POINTS]}) FROM scored)) AS t),
ag AS (SELECT f, t, count(*) FILTER (score < t) AS kept, count(*) FILTER (score >= t) AS deferred, count(*) FILTER (score >= t AND target = 1) AS tp, count(*) FILTER (score < t AND target = 1) AS fn,
  count(*) FILTER (score >= t AND target = 0) AS fp, count(*) FILTER (score < t AND target = 0) AS tn FROM th, scored GROUP BY f, t)
SELECT 'n_chars' AS score_column, {sql_rounded('f', 'deferral_fraction')}, {sql_rounded('t', 'threshold')}, {sql_rounded('coalesce(tp / nullif(tp + fn, 0), -1)', 'sensitivity')}, {sql_rounded('coalesce(tn / nullif(tn + fp, 0), -1)', 'specificity')},
  {sql_rounded('coalesce(tp / nullif(tp + fp, 0), -1)', 'ppv')}, {sql_rounded('coalesce(tn / nullif(tn + fn, 0), -1)', 'npv')}, kept AS kept_n, deferred AS deferred_n FROM ag"""


def _unit_long(spark, sf_dir):
    return doc_long(spark, sf_dir).withColumn("score", F.least(F.col("score") / 10000, F.lit(1.0)))


def _calibration(binning):
    def query(spark, sf_dir):
        return E.calibration_metrics(_unit_long(spark, sf_dir), 10, binning).select("score_column", rounded("ece"), rounded("mce"), rounded("brier_score"))

    return query


UNIT = f"{X.DOC_SCORES}, un AS (SELECT least(score / 10000, 1.0) AS s, target AS t FROM scored)"
QUERIES["calibration_equal_width"] = _calibration("equal_width")
QUERIES["calibration_equal_count"] = _calibration("equal_count")
_CAL = f"""bn AS (SELECT s, t, least(len(list_filter(edges, lambda e: e <= s)), len(edges) - 1) AS b FROM un, ed),
pb AS (SELECT b, count(*) AS n, abs(avg(s) - avg(t)) AS gap, sum((s - t) * (s - t)) AS sq FROM bn GROUP BY b)
SELECT 'n_chars' AS score_column, {sql_rounded('sum(n * gap) / sum(n)', 'ece')}, {sql_rounded('max(gap)', 'mce')}, {sql_rounded('sum(sq) / sum(n)', 'brier_score')} FROM pb"""
ORACLES["calibration_equal_width"] = f"WITH {UNIT}, ed AS (SELECT {[k / 10 for k in range(11)]}::DOUBLE[] AS edges), {_CAL}"
ORACLES["calibration_equal_count"] = f"WITH {UNIT}, ed AS (SELECT list_sort(list_distinct(quantile_cont(s, {[k / 10 for k in range(11)]}))) AS edges FROM un), {_CAL}"

ROC_SQL = f"""WITH {X.DOC_SCORES}, tg AS (SELECT score, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM scored GROUP BY score),
w AS (SELECT score, p, n, sum(p) OVER d AS cp, sum(n) OVER d AS cn, lead(p) OVER d AS lp, lead(n) OVER d AS ln, lag(score) OVER d AS ls FROM tg WINDOW d AS (ORDER BY score DESC)),
k AS (SELECT score AS threshold, cn / (SELECT sum(n) FROM tg) AS fpr, cp / (SELECT sum(p) FROM tg) AS tpr FROM w WHERE ls IS NULL OR lp IS NULL OR lp <> p OR ln <> n UNION ALL SELECT 'Infinity'::DOUBLE, 0, 0),
rt AS (SELECT row_number() OVER (ORDER BY threshold DESC) - 1 AS idx, threshold, fpr, tpr FROM k)"""


def roc_table(spark, sf_dir):
    out = E.roc_table(doc_long(spark, sf_dir))
    return out.select("idx", F.when(F.col("idx") > 0, F.col("threshold")).alias("threshold"), *[rounded(c) for c in ("fpr", "tpr", "fnr", "tnr")])


QUERIES["roc_table"] = roc_table
ORACLES["roc_table"] = f"{ROC_SQL} SELECT idx, CASE WHEN idx > 0 THEN threshold END AS threshold, {sql_rounded('fpr', 'fpr')}, {sql_rounded('tpr', 'tpr')}, {sql_rounded('1 - tpr', 'fnr')}, {sql_rounded('1 - fpr', 'tnr')} FROM rt"


def thr_at_fpr(spark, sf_dir):
    return E.threshold_at_fpr(doc_long(spark, sf_dir), 0.2).select("threshold", rounded("fpr"), rounded("tpr"))


def thr_at_sens(spark, sf_dir):
    return E.threshold_at_sensitivity(doc_long(spark, sf_dir), 0.8).select("threshold", rounded("fpr"), rounded("tpr"))


QUERIES["thr_at_fpr"], QUERIES["thr_at_sens"] = thr_at_fpr, thr_at_sens
_PICK = f"SELECT threshold, {sql_rounded('fpr', 'fpr')}, {sql_rounded('tpr', 'tpr')} FROM rt"
ORACLES["thr_at_fpr"] = f"{ROC_SQL} {_PICK} WHERE fpr <= 0.2 ORDER BY tpr DESC, idx LIMIT 1"
ORACLES["thr_at_sens"] = f"{ROC_SQL} {_PICK} WHERE tpr >= 0.8 ORDER BY fpr, idx LIMIT 1"


def apply_threshold(spark, sf_dir):
    d = X.doc_scores(spark, sf_dir)
    return d.select("doc_id", U.flagged(F.col("score"), 2000.0).alias("above"), U.flagged(F.col("score"), 2000.0, "less").alias("below"))


QUERIES["apply_threshold"] = apply_threshold
ORACLES["apply_threshold"] = f"WITH {X.DOC_SCORES} SELECT doc_id, score >= 2000 AS above, score <= 2000 AS below FROM scored"


def failure_table(spark, sf_dir):
    return E.failure_table(doc_long(spark, sf_dir), 25, "doc_id").select("doc_id", "score", rounded("score_percentile"), "target", "high_score_correct_outcome")


QUERIES["failure_table"] = failure_table
ORACLES["failure_table"] = f"""WITH {X.DOC_SCORES} SELECT doc_id, score, {sql_rounded('(rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / count(*) OVER ()', 'score_percentile')}, target, target = 1 AS high_score_correct_outcome
FROM scored ORDER BY score DESC, doc_id LIMIT 25"""


def cells(spark, sf_dir):
    """One row a trajectory: two signals and the label, for cell tables. States
    are made once and read twice; the rows are written, being read several
    times by what uses them."""
    states = cut_lineage(X.states(spark, sf_dir).select("trajectory_id", "position", "distribution", "mass_capture"), "states")
    s = trajectory.scores(states).select("trajectory_id", F.round("mean_entropy", 9).alias("me"))
    d = trajectory.dynamics(states, X.SPACE).select("trajectory_id", F.round("volatility_mean", 9).alias("js"))
    return cut_lineage(s.join(d, "trajectory_id").join(X.truth(spark, sf_dir), "trajectory_id").withColumn("key", F.lit(0)), "cells")


CELLS = f"{STEPS}, {X.TRUTH}, cl AS (SELECT trajectory_id, me, js, target FROM (SELECT trajectory_id, round(coalesce(avg(h), 0), 9) AS me FROM ent GROUP BY 1) JOIN (SELECT trajectory_id, round(coalesce(avg(moved), 0), 9) AS js FROM dy GROUP BY 1) USING (trajectory_id) JOIN truth USING (trajectory_id))"


def _wilson_sql(k, n, z="1.96"):
    centre = f"({k} / {n} + {z} * {z} / (2 * {n})) / (1 + {z} * {z} / {n})"
    half = f"{z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {z} * {z} / (4 * {n} * {n})) / (1 + {z} * {z} / {n})"
    return f"{centre} - {half}", f"{centre} + {half}"


def quadrant_table(spark, sf_dir):
    """Median by upper-quartile cells with Wilson intervals."""
    rows = cells(spark, sf_dir)
    cut = quantiles(rows, ["key"], "me", {"me_cut": 0.5}).join(quantiles(rows, ["key"], "js", {"js_cut": 0.75}), "key")
    tagged = rows.join(cut, "key").select("target", F.when(F.col("me") < F.col("me_cut"), "confident").otherwise("uncertain").alias("certainty"), F.when(F.col("js") > F.col("js_cut"), "disagree").otherwise("agree").alias("agreement"))
    counts = tagged.groupBy("certainty", "agreement").agg(F.count("*").alias("n"), F.sum("target").alias("k"))
    lo, hi = U.wilson(F.col("k"), F.col("n"))
    return counts.select("certainty", "agreement", "n", "k", rounded(F.col("k") / F.col("n"), "wrong_rate"), rounded(lo, "lo"), rounded(hi, "hi"))


QUERIES["quadrant_table"] = quadrant_table
_LO, _HI = _wilson_sql("k", "n")
QUAD = f"""WITH {CELLS}, ct AS (SELECT quantile_cont(me, 0.5) AS mc, quantile_cont(js, 0.75) AS jc FROM cl),
qd AS (SELECT CASE WHEN me < mc THEN 'confident' ELSE 'uncertain' END AS certainty, CASE WHEN js > jc THEN 'disagree' ELSE 'agree' END AS agreement, count(*) AS n, sum(target) AS k FROM cl, ct GROUP BY 1, 2)"""
ORACLES["quadrant_table"] = f"{QUAD} SELECT certainty, agreement, n, CAST(k AS BIGINT) AS k, {sql_rounded('k / n', 'wrong_rate')}, {sql_rounded(_LO, 'lo')}, {sql_rounded(_HI, 'hi')} FROM qd"


def triage_flag(spark, sf_dir):
    """Lift of the confident & disagree cell over confident & agree."""
    quad = quadrant_table(spark, sf_dir)
    rate = lambda a: F.max(F.when((F.col("certainty") == "confident") & (F.col("agreement") == a), F.col("wrong_rate")))
    low = F.max(F.when((F.col("certainty") == "confident") & (F.col("agreement") == "disagree"), F.col("lo")))
    base = F.sum("k") / F.sum("n")
    out = quad.agg(rate("disagree").alias("flag"), rate("agree").alias("ref"), low.alias("lo"), base.alias("base"))
    lift = F.coalesce(F.col("flag") - F.col("ref"), F.lit(0.0))
    return out.select(rounded("base"), rounded(lift, "lift"), F.coalesce((lift >= 0.15) & (F.col("lo") > F.col("base")), F.lit(False)).alias("validates"))


QUERIES["triage_flag"] = triage_flag
ORACLES["triage_flag"] = f"""{QUAD}, t AS (SELECT max(k / n) FILTER (certainty = 'confident' AND agreement = 'disagree') AS f, max(k / n) FILTER (certainty = 'confident' AND agreement = 'agree') AS r,
  max({_LO}) FILTER (certainty = 'confident' AND agreement = 'disagree') AS lo, sum(k) / sum(n) AS base FROM qd)
SELECT {sql_rounded('base', 'base')}, {sql_rounded('coalesce(round(f, 6) - round(r, 6), 0)', 'lift')}, coalesce(f - r >= 0.15 AND lo > base, false) AS validates FROM t"""


def tertile_cell(spark, sf_dir):
    """Both signals in their upper third: lift and its one-sided bound."""
    rows = cells(spark, sf_dir)
    q = 2 / 3
    cut = quantiles(rows, ["key"], "me", {"me_cut": q}).join(quantiles(rows, ["key"], "js", {"js_cut": q}), "key")
    high = (F.col("me") >= F.col("me_cut")) & (F.col("js") >= F.col("js_cut"))
    out = rows.join(cut, "key").agg(F.avg("target").alias("base"), F.sum(high.cast("int")).alias("n"), F.sum(F.when(high, F.col("target")).otherwise(0)).alias("k"))
    lo, _ = U.wilson(F.col("k"), F.col("n"), U.Z_ONE_SIDED)
    lift = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.0) - F.col("base")
    return out.select(rounded("base"), "n", "k", rounded(lift * 100, "lift_pp"), rounded((lo - F.col("base")) * 100, "lift_low_pp"))


QUERIES["tertile_cell"] = tertile_cell
_LO1, _ = _wilson_sql("k", "n", str(U.Z_ONE_SIDED))
ORACLES["tertile_cell"] = f"""WITH {CELLS}, ct AS (SELECT quantile_cont(me, 2.0/3) AS mc, quantile_cont(js, 2.0/3) AS jc FROM cl),
t AS (SELECT avg(target) AS base, count(*) FILTER (me >= mc AND js >= jc) AS n, coalesce(sum(target) FILTER (me >= mc AND js >= jc), 0) AS k FROM cl, ct)
SELECT {sql_rounded('base', 'base')}, n, CAST(k AS BIGINT) AS k, {sql_rounded('(k / n - base) * 100', 'lift_pp')}, {sql_rounded(f'({_LO1} - base) * 100', 'lift_low_pp')} FROM t""".replace("2.0/3)", f"{2 / 3})")


def bottom_decile_lift(spark, sf_dir):
    return prereg.bottom_decile(cells(spark, sf_dir), "me").select("n", "k", rounded("base"), rounded("lift_pp"), rounded("lift_low_pp"))


QUERIES["bottom_decile_lift"] = bottom_decile_lift
ORACLES["bottom_decile_lift"] = f"""WITH {CELLS}, ct AS (SELECT quantile_cont(me, 0.1) AS mc FROM cl), t AS (SELECT count(*) FILTER (me <= mc) AS n, sum(target) FILTER (me <= mc) AS k, avg(target) AS base FROM cl, ct)
SELECT n, CAST(k AS BIGINT) AS k, {sql_rounded('base', 'base')}, {sql_rounded('(k / n - base) * 100', 'lift_pp')}, {sql_rounded(f'({_LO1} - base) * 100', 'lift_low_pp')} FROM t"""


def position_medians(spark, sf_dir):
    """pos_median: median entropy by position and class, where both classes
    have ten states or more."""
    s = trajectory.with_entropy(X.states(spark, sf_dir)).where("h is not null").join(X.truth(spark, sf_dir), "trajectory_id").select("position", "target", F.round("h", 9).alias("h"))
    med = quantiles(s, ["position", "target"], "h", {"median": 0.5}).join(s.groupBy("position", "target").agg(F.count("*").alias("n")), ["position", "target"])
    wide = med.groupBy("position").agg(*[F.max(F.when(F.col("target") == t, F.col(c))).alias(f"{c}_{t}") for t in (0, 1) for c in ("median", "n")])
    return wide.where("n_0 >= 10 and n_1 >= 10").select("position", "n_0", "n_1", rounded("median_0"), rounded("median_1"))


QUERIES["pos_median"] = position_medians
ORACLES["pos_median"] = f"""WITH {X.STATES}, {X.TRUTH}, p AS (SELECT position, target, round(h, 9) AS h FROM ent JOIN truth USING (trajectory_id) WHERE h IS NOT NULL)
SELECT position, count(*) FILTER (target = 0) AS n_0, count(*) FILTER (target = 1) AS n_1, {sql_rounded('quantile_cont(h, 0.5) FILTER (target = 0)', 'median_0')}, {sql_rounded('quantile_cont(h, 0.5) FILTER (target = 1)', 'median_1')}
FROM p GROUP BY position HAVING count(*) FILTER (target = 0) >= 10 AND count(*) FILTER (target = 1) >= 10"""
