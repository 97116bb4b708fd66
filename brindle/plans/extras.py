"""Summaries, pre-registered rules, file sources and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import uncertainty as U
from brindle.operators import evaluate as E
from brindle.operators import prereg, trajectory
from brindle.operators import stats as S
from brindle.operators.ordered import quantiles, rank_percentiles
from brindle.plans.common import rounded, sql_rounded
from brindle.plans.evaluation import auc_sql
from brindle.plans.scores import PER_TRAJECTORY, TOP_K, K, _rp
from brindle.sources import fixtures as X
from brindle.sources.store import cut_lineage, shared_dir

QUERIES, ORACLES = {}, {}


def mass_summary(spark, sf_dir):
    """Least, median, mean and most mass; right less wrong; the wrong rate of
    states with little mass."""
    s = X.states(spark, sf_dir).where("mass_capture is not null").join(X.truth(spark, sf_dir), "trajectory_id").select("target", F.round("mass_capture", 9).alias("m")).withColumn("key", F.lit(0))
    base = s.groupBy("key").agg(F.count("*").alias("n"), F.min("m").alias("least"), F.max("m").alias("most"), F.avg("m").alias("mean"), (F.avg(F.when(F.col("target") == 0, F.col("m"))) - F.avg(F.when(F.col("target") == 1, F.col("m")))).alias("delta"), F.sum((F.col("m") < 0.92).cast("int")).alias("n_tail"), F.avg(F.when(F.col("m") < 0.92, F.col("target"))).alias("tail_rate"))
    return base.join(quantiles(s, ["key"], "m", {"median": 0.5}), "key").select("n", "n_tail", *[rounded(c) for c in ("least", "most", "mean", "delta", "tail_rate", "median")])


QUERIES["mass_summary"] = mass_summary
ORACLES["mass_summary"] = f"""WITH {X.STATES}, {X.TRUTH}, m AS (SELECT target, round(mass_capture, 9) AS m FROM states JOIN truth USING (trajectory_id) WHERE mass_capture IS NOT NULL)
SELECT count(*) AS n, count(*) FILTER (m < 0.92) AS n_tail, {sql_rounded('min(m)', 'least')}, {sql_rounded('max(m)', 'most')}, {sql_rounded('avg(m)', 'mean')}, {sql_rounded('avg(m) FILTER (target = 0) - avg(m) FILTER (target = 1)', 'delta')},
  {sql_rounded('avg(target) FILTER (m < 0.92)', 'tail_rate')}, {sql_rounded('quantile_cont(m, 0.5)', 'median')} FROM m"""


def fig_pos_median(spark, sf_dir):
    """Median entropy at positions 0 to 5 by class, no least count."""
    s = trajectory.with_entropy(X.states(spark, sf_dir)).where("h is not null and position <= 5").join(X.truth(spark, sf_dir), "trajectory_id").select("position", "target", F.round("h", 9).alias("h"))
    return quantiles(s, ["position", "target"], "h", {"median": 0.5}).select("position", "target", rounded("median"))


QUERIES["fig_pos_median"] = fig_pos_median
ORACLES["fig_pos_median"] = f"WITH {X.STATES}, {X.TRUTH}, p AS (SELECT position, target, round(h, 9) AS h FROM ent JOIN truth USING (trajectory_id) WHERE h IS NOT NULL AND position <= 5) SELECT position, target, {sql_rounded('quantile_cont(h, 0.5)', 'median')} FROM p GROUP BY 1, 2"


FEATURES = ["mean_entropy", "terminal_entropy", "entropy_plateau", "corrected_3", "mean_p_max", "mean_top_k_mass", "mean_gap_top2"]
SMOKE = 0.55


def features(states, spark, sf_dir):
    """One row a trajectory: the scores that the rules are about."""
    base = cut_lineage(trajectory.scores(states).where("n_positions > 0"), "scores")  # read twice below
    top = trajectory.top_k_scores(states, K).select("trajectory_id", "mean_p_max", "mean_top_k_mass", "mean_gap_top2")
    r = lambda c, s: F.round(F.col(c) * s, 9) + 0.0
    ranks = rank_percentiles(base, "trajectory_id", {"a": r("max_entropy", 1), "b": r("terminal_entropy", 1), "c": r("entropy_plateau", -1)})
    rows = base.join(top, "trajectory_id").join(ranks.select("trajectory_id", ((F.col("a") + F.col("b") + F.col("c")) / 3).alias("corrected_3")), "trajectory_id")
    rows = rows.select("trajectory_id", *[F.round(c, 9).alias(c) for c in [*FEATURES, "mass_capture_mean"]]).join(X.truth(spark, sf_dir), "trajectory_id")
    return cut_lineage(rows, "features")


def _facts(states, rows):
    keyed = rows.withColumn("key", F.lit(0))
    med = lambda t, name: quantiles(keyed.where(F.col("target") == t), ["key"], "mass_capture_mean", {name: 0.5})
    mass = prereg.bottom_decile(rows, "mass_capture_mean").select(F.lit(0).alias("key"), "lift_pp", "lift_low_pp")
    gap = prereg.bottom_decile(rows, "mean_gap_top2").select(F.lit(0).alias("key"), F.col("lift_pp").alias("gap_lift_pp"))
    d = S.cohen_d(rows, "mass_capture_mean").select(F.lit(0).alias("key"), F.col("d").alias("cohen_d"))
    rho = S.spearman(rows, "trajectory_id", "mean_top_k_mass", "mean_entropy").select(F.lit(0).alias("key"), F.col("rho").alias("spearman"))
    failed = states.groupBy(F.lit(0).alias("key")).agg(F.avg(F.col("distribution").isNull().cast("int")).alias("failure_rate"))
    out = med(1, "m1").join(med(0, "m0"), "key").withColumn("delta_median", F.col("m1") - F.col("m0"))
    for more in (mass, gap, d, rho, failed):
        out = out.join(more, "key")
    return out.withColumn("smoke", F.lit(SMOKE))


def _areas(spark, sf_dir, rows, with_ci):
    long = rows.select("trajectory_id", "target", F.inline(F.array(*[F.struct(F.lit(c).alias("score_column"), F.col(c).alias("score")) for c in FEATURES])))
    if with_ci:
        return E.auc_with_ci(long, bounded=[*prereg.DISABLED, *prereg.ENABLED])
    return E.deferral_auc(long).select("score_column", F.round("roc_auc_sign_aware", 9).alias("sign_aware"), "direction", F.lit(None).cast("double").alias("ci_low"))


def prereg_rules(spark, sf_dir):
    """The predictions that need no interval."""
    states = cut_lineage(X.states(spark, sf_dir), "states")  # read three times
    rows = features(states, spark, sf_dir)
    return prereg.rules(_areas(spark, sf_dir, rows, False), _facts(states, rows)).where("rule not in ('P1', 'P4')").select("rule", rounded("measured"), "held")


def prereg_rules_ci(spark, sf_dir):
    """All ten, with bootstrap intervals."""
    states = cut_lineage(X.states(spark, sf_dir), "states")  # read three times
    rows = features(states, spark, sf_dir)
    return prereg.rules(_areas(spark, sf_dir, rows, True), _facts(states, rows)).select("rule", "measured", "held")


QUERIES["prereg_rules"], QUERIES["prereg_rules_ci"] = prereg_rules, prereg_rules_ci
_TK = ", ".join(f"coalesce(avg(CASE WHEN tk IS NOT NULL THEN {TOP_K[n][1]} END), 0) AS {n}" for n in ("mean_p_max", "mean_top_k_mass", "mean_gap_top2"))
_RANKED = " + ".join(_rp(f"(round({c} * {s}, 9) + 0.0)") for c, s in (("max_entropy", 1), ("terminal_entropy", 1), ("entropy_plateau", -1)))
_NUMBERED = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
_LOWEST = "(k / n + {z} * {z} / (2 * n) - {z} * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n)".format(z=U.Z_ONE_SIDED)
_DECILE = "(SELECT {} FROM (SELECT avg(target) AS base, count(*) FILTER ({c} <= q) AS n, sum(target) FILTER ({c} <= q)::DOUBLE AS k FROM ft, (SELECT quantile_cont({c}, 0.1) AS q FROM ft)))"
ORACLES["prereg_rules"] = f"""WITH {PER_TRAJECTORY}, {X.TRUTH}, tp AS (SELECT trajectory_id, {_TK} FROM ent GROUP BY 1),
cr AS (SELECT trajectory_id, ({_RANKED}) / 3 AS corrected_3 FROM tr WHERE n_positions > 0),
ft AS (SELECT trajectory_id, target, {', '.join(f'round({c}, 9) AS {c}' for c in [*FEATURES, 'mass_capture_mean'])} FROM tr JOIN tp USING (trajectory_id) JOIN cr USING (trajectory_id) JOIN truth USING (trajectory_id)),
lg AS ({' UNION ALL '.join(f"SELECT '{c}' AS score_column, {c} AS score, target FROM ft" for c in FEATURES)}), {auc_sql('lg')},
sa AS (SELECT score_column, round(greatest(roc_auc, 1 - roc_auc), 9) AS a FROM roc),
ar AS (SELECT {', '.join(f"max(a) FILTER (score_column = '{c}') AS {c}" for c in FEATURES)} FROM sa),
rk2 AS (SELECT {_NUMBERED('mean_top_k_mass')} AS x, {_NUMBERED('mean_entropy')} AS y FROM ft),
st2 AS (SELECT avg(mass_capture_mean) FILTER (target = 1) - avg(mass_capture_mean) FILTER (target = 0) AS dm, count(*) FILTER (target = 1) AS n1, count(*) FILTER (target = 0) AS n0, var_samp(mass_capture_mean) FILTER (target = 1) AS v1, var_samp(mass_capture_mean) FILTER (target = 0) AS v0,
  quantile_cont(mass_capture_mean, 0.5) FILTER (target = 1) - quantile_cont(mass_capture_mean, 0.5) FILTER (target = 0) AS med FROM ft),
fc AS (SELECT med, dm / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d, {_DECILE.format('(k / n - base) * 100', c='mass_capture_mean')} AS lift, {_DECILE.format(f'({_LOWEST} - base) * 100', c='mass_capture_mean')} AS low,
  {_DECILE.format('(k / n - base) * 100', c='mean_gap_top2')} AS gap, (SELECT corr(x, y) FROM rk2) AS rho, (SELECT avg(CASE WHEN dist IS NULL THEN 1 ELSE 0 END) FROM states) AS failed FROM st2),
ru AS (SELECT unnest([
  {{'rule': 'P2', 'measured': mean_entropy - corrected_3, 'held': mean_entropy - corrected_3 >= {prereg.P2_DELTA}}},
  {{'rule': 'P3', 'measured': abs(mean_entropy - {SMOKE}), 'held': abs(mean_entropy - {SMOKE}) <= {prereg.P3_BAND}}},
  {{'rule': 'P5a', 'measured': med, 'held': abs(med) < {prereg.P5A_MEDIAN} AND abs(d) < {prereg.P5A_D}}},
  {{'rule': 'P5b', 'measured': lift, 'held': lift BETWEEN {prereg.P5B_LIFT[0]} AND {prereg.P5B_LIFT[1]} AND low > 0}},
  {{'rule': 'P6', 'measured': failed, 'held': failed < {prereg.P6_FAILED}}},
  {{'rule': 'E1', 'measured': mean_p_max, 'held': mean_p_max BETWEEN {prereg.E1_AUC[0]} AND {prereg.E1_AUC[1]}}},
  {{'rule': 'E2', 'measured': mean_top_k_mass - mean_entropy, 'held': mean_top_k_mass - mean_entropy >= {prereg.E2_DELTA} AND rho >= {prereg.E2_SPEARMAN}}},
  {{'rule': 'E3', 'measured': mean_gap_top2, 'held': mean_gap_top2 >= {prereg.E3_AUC} AND gap >= {prereg.E3_LIFT}}}]) AS r FROM ar, fc)
SELECT r.rule AS rule, {sql_rounded('r.measured', 'measured')}, r.held AS held FROM ru"""


def f_dropnan(spark, sf_dir):
    """Missing scores (null or NaN) are counted and dropped."""
    s = X.states(spark, sf_dir)
    v = F.when(F.col("position") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("mass_capture"))
    return s.select("trajectory_id", v.alias("v")).groupBy("trajectory_id").agg(F.count("*").alias("n"), F.sum((~U.present(F.col("v"))).cast("int")).alias("dropped"), rounded(F.avg(F.when(U.present(F.col("v")), F.col("v"))), "mean"))


QUERIES["f_dropnan"] = f_dropnan
ORACLES["f_dropnan"] = f"WITH {X.STATES} SELECT trajectory_id, count(*) AS n, count(*) FILTER (position % 5 = 0 OR mass_capture IS NULL) AS dropped, {sql_rounded('avg(mass_capture) FILTER (position % 5 <> 0)', 'mean')} FROM states GROUP BY 1"


def f_subset_mask(spark, sf_dir):
    """A mask on the truth, and scores of the units that pass it."""
    kept = X.doc_scores(spark, sf_dir).where("toxic = 1 and lang = 'en'").select("doc_id")
    return X.doc_scores(spark, sf_dir).select("doc_id", "score").join(kept, "doc_id", "left_semi")


QUERIES["f_subset_mask"] = f_subset_mask
ORACLES["f_subset_mask"] = f"WITH {X.DOC_SCORES} SELECT doc_id, score FROM scored WHERE toxic = 1 AND lang = 'en'"
QUERIES["join_intersection"] = lambda s, d: X.table(s, d, "documents").select(F.col("doc_id").alias("id")).join(X.table(s, d, "embeddings").select(F.col("vec_id").alias("id")), "id")
ORACLES["join_intersection"] = "SELECT doc_id AS id FROM documents JOIN embeddings ON vec_id = doc_id"


def agg_per_state(spark, sf_dir):
    """One extractor, three aggregations, each with its default."""
    s = X.states(spark, sf_dir)
    value = U.gap_top2(F.col("top_k"))
    return s.groupBy("trajectory_id").agg(*[trajectory.per_state(h, F.when(F.size("top_k") > 0, value), h, -1.0) for h in ("mean", "min", "max")]).select("trajectory_id", *[rounded(h) for h in ("mean", "min", "max")])


QUERIES["agg_per_state"] = agg_per_state
_GAP = "CASE WHEN len(tk) >= 2 THEN exp(tk[1]) - exp(tk[2]) WHEN len(tk) = 1 THEN 0 END"
ORACLES["agg_per_state"] = f"WITH {X.STATES} SELECT trajectory_id, {sql_rounded(f'coalesce(avg({_GAP}), -1)', 'mean')}, {sql_rounded(f'coalesce(min({_GAP}), -1)', 'min')}, {sql_rounded(f'coalesce(max({_GAP}), -1)', 'max')} FROM states GROUP BY 1"


def files_round_trip(spark, sf_dir):
    """Scores as CSV and JSON lines and back (src_csv, src_jsonl)."""
    import uuid

    scores = trajectory.scores(X.states(spark, sf_dir)).select("trajectory_id", rounded("mean_entropy"))
    base = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    scores.write.option("header", True).csv(f"{base}/csv")
    scores.write.json(f"{base}/json")
    csv = spark.read.schema(scores.schema).option("header", True).csv(f"{base}/csv")
    lines = spark.read.schema(scores.schema).json(f"{base}/json").withColumnRenamed("mean_entropy", "from_json")
    return csv.join(lines, "trajectory_id").select("trajectory_id", "mean_entropy", "from_json")


QUERIES["src_csv_jsonl"] = files_round_trip
ORACLES["src_csv_jsonl"] = f"WITH {PER_TRAJECTORY} SELECT trajectory_id, {sql_rounded('mean_entropy', 'mean_entropy')}, {sql_rounded('mean_entropy', 'from_json')} FROM tr"


def no_roots(spark, sf_dir):
    """Events by type alone: every node has an incoming edge."""
    from brindle.operators import graph as G

    steps = X.transitions(spark, sf_dir).withColumn("node_id", F.split("node_id", "@")[0])
    edges = G.transitions(steps)
    return G.density(steps.select("node_id").distinct(), edges).select("n_nodes", "n_edges").withColumn("n_roots", F.lit(0) + G.roots(steps.select("node_id").distinct(), edges).count())


QUERIES["no_root_graph"] = no_roots
ORACLES["no_root_graph"] = f"""WITH {X.TRANSITIONS}, n AS (SELECT trajectory_id, position, split_part(node_id, '@', 1) AS s, action_id, lead(split_part(node_id, '@', 1)) OVER (PARTITION BY trajectory_id ORDER BY position) AS t FROM walk),
e AS (SELECT DISTINCT s, action_id, t FROM n WHERE t IS NOT NULL) SELECT (SELECT count(DISTINCT s) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, CAST((SELECT count(DISTINCT s) FROM n WHERE s NOT IN (SELECT t FROM e)) AS INTEGER) AS n_roots"""


def distributed_auc(spark, sf_dir):
    """Areas of all state-level scores: a larger table than trajectories."""
    s = X.states(spark, sf_dir).where("distribution is not null").join(X.truth(spark, sf_dir), "trajectory_id")
    pairs = F.array(*[F.struct(F.lit(n).alias("score_column"), F.round(c, 6).alias("score")) for n, c in (("entropy", U.entropy_bits(F.col("distribution"))), ("mass", F.col("mass_capture")))])
    return E.deferral_auc(s.select("target", F.inline(pairs))).select("score_column", rounded("roc_auc"), rounded("pr_auc"), "n_pos", "n_neg")


QUERIES["state_level_auc"] = distributed_auc
ORACLES["state_level_auc"] = f"WITH {X.STATES}, {X.TRUTH}, lg AS (SELECT 'entropy' AS score_column, round(h, 6) AS score, target FROM ent JOIN truth USING (trajectory_id) WHERE dist IS NOT NULL UNION ALL SELECT 'mass', round(mass_capture, 6), target FROM ent JOIN truth USING (trajectory_id) WHERE dist IS NOT NULL), {auc_sql('lg')} SELECT score_column, {sql_rounded('roc_auc', 'roc_auc')}, {sql_rounded('pr_auc', 'pr_auc')}, n_pos, n_neg FROM roc JOIN pr USING (score_column)"


def _domains(spark, sf_dir):
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("target"), "o_orderpriority")
    names = [f"{k}-{n}" for k, n in zip("12345", ("URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"), strict=True)]
    return {n: orders.where(F.col("o_orderpriority") == n) for n in names}


def cross_domain(spark, sf_dir):
    """Domains (order priorities) with labels of their own."""
    d = _domains(spark, sf_dir)
    found = E.grouped_comparison(d, d, "domain", "o_totalprice", unit="o_orderkey", compute_ci=False)
    return found.select("domain", rounded("roc_auc"), "n_pos", "n_neg")


def cross_llm(spark, sf_dir):
    """Models with a score column each, on the same labels."""
    orders = X.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.pmod("o_custkey", F.lit(97)).cast("double").alias("rest"), (F.col("o_orderstatus") == "F").cast("int").alias("target"))
    found = E.grouped_comparison({"price": orders, "customer": orders}, orders, "model", {"price": "o_totalprice", "customer": "rest"}, unit="o_orderkey", compute_ci=False)
    return found.select("model", rounded("roc_auc"), "n_pos", "n_neg")


_AREA = "(sum(r) FILTER (t = 1) - count(*) FILTER (t = 1) * (count(*) FILTER (t = 1) + 1) / 2) / (count(*) FILTER (t = 1) * count(*) FILTER (t = 0))"
_AREAS = lambda key, rows: f"""WITH o AS ({rows}), r AS (SELECT *, rank() OVER (PARTITION BY {key} ORDER BY s) + (count(*) OVER (PARTITION BY {key}, s) - 1) / 2 AS r FROM o)
SELECT {key}, {sql_rounded(_AREA, 'roc_auc')}, count(*) FILTER (t = 1) AS n_pos, count(*) FILTER (t = 0) AS n_neg FROM r GROUP BY 1"""  # noqa: E731
QUERIES["cross_domain"] = cross_domain
ORACLES["cross_domain"] = _AREAS("domain", "SELECT o_orderpriority AS domain, o_totalprice AS s, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS t FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')")
QUERIES["cross_llm"] = cross_llm
ORACLES["cross_llm"] = _AREAS("model", "SELECT 'price' AS model, o_totalprice AS s, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS t FROM orders UNION ALL SELECT 'customer', o_custkey % 97, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END FROM orders")
