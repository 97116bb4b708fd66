"""Scalars of a state, scores of a trajectory, belief dynamics, composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import uncertainty as U
from brindle.operators import evaluate, trajectory
from brindle.operators.ordered import rank_percentiles as rank_percentiles_of
from brindle.plans.common import rounded, sql_rounded
from brindle.sources import fixtures as X

QUERIES, ORACLES = {}, {}
K = 3

TK = "coalesce(tk, [])"
PROBS = "list_transform(tk, lambda x: exp(x))"
TOTAL = f"list_sum({PROBS})"

#: name: (column over a state, the same in SQL); null where there is no data.
SCALARS = {
    "entropy_bits": (lambda: U.entropy_bits(F.col("distribution")), "h"),
    "entropy_nats_hyp": (lambda: U.entropy_nats(F.col("distribution")), "h * ln(2)"),
    "p_max": (lambda: U.p_max(F.col("top_k")), "exp(list_max(tk))"),
    "chosen_logprob": (lambda: U.chosen_logprob(F.col("top_k")), "list_max(tk)"),
    "entropy_full": (
        lambda: U.entropy_full(F.slice("top_k", 1, K)),
        f"-list_sum(list_transform(tk[1:{K}], lambda x: exp(x) * x)) - CASE WHEN 1 - list_sum(list_transform(tk[1:{K}], lambda x: exp(x))) > 1e-9 THEN (1 - list_sum(list_transform(tk[1:{K}], lambda x: exp(x)))) * ln(1 - list_sum(list_transform(tk[1:{K}], lambda x: exp(x)))) ELSE 0 END",
    ),
    "top_k_mass": (lambda: U.top_k_mass(F.col("top_k"), K), f"list_sum({PROBS}[1:{K}])"),
    "gap_top2": (lambda: U.gap_top2(F.col("top_k")), "CASE WHEN len(tk) >= 2 THEN exp(tk[1]) - exp(tk[2]) ELSE 0 END"),
    "gap_top1_topk": (lambda: U.gap_top1_top_k(F.col("top_k"), K), f"CASE WHEN len(tk) >= {K} THEN exp(tk[1]) - exp(tk[{K}]) ELSE 0 END"),
    "varentropy": (
        lambda: U.varentropy(F.slice("top_k", 1, K)),
        f"(WITH p AS (SELECT exp(x) / sum(exp(x)) OVER () AS v FROM unnest(tk[1:{K}]) AS t(x)) SELECT sum(v * ln(v) * ln(v)) - sum(v * ln(v)) * sum(v * ln(v)) FROM p)",
    ),
    "entfull_renorm": (
        lambda: U.entropy_full_renormalized(F.slice("top_k", 1, K)),
        f"(WITH p AS (SELECT exp(x) / sum(exp(x)) OVER () AS v FROM unnest(tk[1:{K}]) AS t(x)) SELECT -sum(v * ln(v)) FROM p)",
    ),
    "mass_capture": (lambda: F.col("mass_capture"), "mass_capture"),
    "l1_dist": (lambda: U.l1_distance(U.projected(F.col("distribution"), X.SPACE), F.array(*[F.lit(1 / 3)] * 3)), "abs(dist[1] - 1.0/3) + abs(dist[2] - 1.0/3) + abs(dist[3] - 1.0/3)"),
    "js_div": (
        lambda: U.js_divergence(U.projected(F.col("distribution"), X.SPACE), F.array(*[F.lit(1 / 3)] * 3)),
        "(SELECT sum(CASE WHEN p > 0 THEN p * log2(p / ((p + 1.0/3) / 2)) ELSE 0 END + 1.0/3 * log2(1.0/3 / ((p + 1.0/3) / 2))) / 2 FROM unnest(dist) AS t(p))",
    ),
}


def _scalar(name, column, expression):
    def query(spark, sf_dir):
        states = X.states(spark, sf_dir).where("distribution is not null")
        return states.select("trajectory_id", "position", rounded(column(), name))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {X.STATES} SELECT trajectory_id, position, {sql_rounded(expression, name)} FROM ent WHERE dist IS NOT NULL"


for _name, (_column, _sql) in SCALARS.items():
    _scalar(_name, _column, _sql)


def entropy_abcd(spark, sf_dir):
    """Projection on other letters: two of the space, one that never occurs."""
    p = U.projected(F.col("distribution"), ["A", "N", "Z"])
    return X.states(spark, sf_dir).where("distribution is not null").select("trajectory_id", "position", rounded(U.entropy_of_list(p), "entropy_abcd"))


QUERIES["entropy_ABCD"] = entropy_abcd
ORACLES["entropy_ABCD"] = f"""WITH {X.STATES}, z AS (
  SELECT trajectory_id, position, CASE WHEN dist[1] + dist[2] > 0 THEN [dist[1] / (dist[1] + dist[2]), dist[2] / (dist[1] + dist[2])] ELSE [1.0/3, 1.0/3, 1.0/3] END AS p FROM states WHERE dist IS NOT NULL)
SELECT trajectory_id, position, {sql_rounded("coalesce((SELECT -sum(x * log2(x)) FROM unnest(p) AS t(x) WHERE x > 0), 0)", "entropy_abcd")} FROM z"""


def renorm_dist(spark, sf_dir):
    """Quantities by flag as unnormalized token masses under three aliases."""
    lines = X.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("l_returnflag") == a, F.col("l_quantity")).otherwise(0.0)).alias(a) for a in X.SPACE]
    )
    tokens = F.create_map(F.lit("A"), F.col("A") / 100, F.lit(" A"), F.col("N") / 400, F.lit("\nN"), F.col("N") / 200, F.lit(" R"), F.col("R") / 100)
    found = U.alias_mass(tokens, X.SPACE)
    out = lines.select("l_orderkey", found.alias("raw"), U.truncated_members(F.map_filter(tokens, lambda k, v: v > 0), X.SPACE).alias("cut")).where(U.mass(F.col("raw")) > 0)
    even = U.renormalized(F.col("raw"))
    return out.select("l_orderkey", rounded(U.mass(F.col("raw")), "captured"), *[rounded(even[a], f"p_{a.lower()}") for a in X.SPACE], F.array_join("cut", ",").alias("truncated"), U.argmax(F.col("raw")).alias("argmax"))


QUERIES["renorm_dist"] = renorm_dist
ORACLES["renorm_dist"] = f"""WITH q AS (
  SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r
  FROM lineitem GROUP BY l_orderkey), m AS (
  SELECT l_orderkey, a / 100 + n / 400 AS ma, n / 200 AS mn, r / 100 AS mr, a, n, r FROM q)
SELECT l_orderkey, {sql_rounded("ma + mn + mr", "captured")}, {sql_rounded("ma / (ma + mn + mr)", "p_a")}, {sql_rounded("mn / (ma + mn + mr)", "p_n")}, {sql_rounded("mr / (ma + mn + mr)", "p_r")},
  concat_ws(',', CASE WHEN NOT (a > 0 OR n > 0) THEN 'A' END, CASE WHEN NOT n > 0 THEN 'N' END, CASE WHEN NOT r > 0 THEN 'R' END) AS truncated,
  CASE WHEN ma >= mn AND ma >= mr THEN 'A' WHEN mn >= mr THEN 'N' ELSE 'R' END AS argmax
FROM m WHERE ma + mn + mr > 0"""


def answer_maps(spark, sf_dir):
    """one_hot and conf_weighted over documents' languages as answers."""
    space = ["de", "en", "es"]
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "lang", (F.pmod("doc_id", F.lit(10)) / 10).alias("c"))
    hot, weighted = U.one_hot(F.col("lang"), space), U.confidence_weighted(F.col("lang"), F.col("c"), space)
    return docs.select("doc_id", *[rounded(hot[a], f"hot_{a}") for a in space], *[rounded(weighted[a], f"conf_{a}") for a in space])


QUERIES["answer_maps"] = answer_maps
ORACLES["answer_maps"] = "WITH d AS (SELECT doc_id, lang, (doc_id % 10) / 10.0::DOUBLE AS c FROM documents) SELECT doc_id, " + ", ".join(
    sql_rounded(f"CASE WHEN lang IN ('de','en','es') THEN CASE WHEN lang = '{a}' THEN 1.0 ELSE 0.0 END ELSE 1.0::DOUBLE/3 END", f"hot_{a}") + ", " + sql_rounded(f"CASE WHEN lang IN ('de','en','es') THEN CASE WHEN lang = '{a}' THEN c ELSE (1 - c) / 2 END ELSE 1.0::DOUBLE/3 END", f"conf_{a}") for a in ("de", "en", "es")
) + " FROM d"

TRAJECTORY = {
    "mean_entropy": "coalesce(avg(h), 0)",
    "entropy_plateau": "coalesce(CASE WHEN count(h) >= 2 THEN regr_slope(h, idx) END, 0)",
    "entropy_slope_ts": "coalesce(CASE WHEN count(h) >= 2 THEN regr_slope(h, position) END, 0)",
    "terminal_entropy": "arg_max(h, position) FILTER (h IS NOT NULL)",
    "initial_entropy": "arg_min(h, position) FILTER (h IS NOT NULL)",
    "max_entropy": "max(h)",
    "n_steps": "count(*)",
    "n_positions": "count(h)",
    "mass_capture_mean": "coalesce(avg(mass_capture), 1)",
    "mass_capture_min": "coalesce(min(mass_capture), 1)",
}
INDEXED = f"{X.STATES}, ix AS (SELECT *, CASE WHEN h IS NOT NULL THEN count(h) OVER (PARTITION BY trajectory_id ORDER BY position) - 1 END AS idx FROM ent)"
PER_TRAJECTORY = f"{INDEXED}, tr AS (SELECT trajectory_id, {', '.join(f'{e} AS {n}' for n, e in TRAJECTORY.items())} FROM ix GROUP BY trajectory_id)"

COUNTS = ("n_steps", "n_positions")


def _trajectory(name):
    def query(spark, sf_dir):
        found = trajectory.scores(X.states(spark, sf_dir))
        return found.select("trajectory_id", F.col(name) if name in COUNTS else rounded(name))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {PER_TRAJECTORY} SELECT trajectory_id, {name if name in COUNTS else sql_rounded(name, name)} FROM tr"


for _name in TRAJECTORY:
    _trajectory(_name)

TOP_K = {
    "mean_p_max": ("avg", SCALARS["p_max"][1]),
    "min_p_max": ("min", SCALARS["p_max"][1]),
    "mean_entropy_full": ("avg", "-list_sum(list_transform(tk, lambda x: exp(x) * x))"),
    "mean_top_k_mass": ("avg", SCALARS["top_k_mass"][1]),
    "min_top_k_mass": ("min", SCALARS["top_k_mass"][1]),
    "mean_gap_top2": ("avg", SCALARS["gap_top2"][1]),
    "min_gap_top2": ("min", SCALARS["gap_top2"][1]),
    "mean_gap_top1_top_k": ("avg", SCALARS["gap_top1_topk"][1]),
}


def _top_k(name, how, expression):
    def query(spark, sf_dir):
        return trajectory.top_k_scores(X.states(spark, sf_dir), K).select("trajectory_id", rounded(name))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {X.STATES} SELECT trajectory_id, {sql_rounded(f'coalesce({how}(CASE WHEN tk IS NOT NULL THEN {expression} END), 0)', name)} FROM ent GROUP BY trajectory_id"


for _name, (_how, _sql) in TOP_K.items():
    _top_k(_name, _how, _sql)


def phase_b_features(spark, sf_dir):
    """The same with no default: NaN for trajectories without lists."""
    found = trajectory.top_k_scores(X.states(spark, sf_dir), K, default=None)
    return found.select("trajectory_id", *[rounded(F.nanvl(F.col(n), F.lit(None).cast("double")), n) for n in TOP_K])


QUERIES["phase_b_features"] = phase_b_features
ORACLES["phase_b_features"] = f"WITH {X.STATES} SELECT trajectory_id, " + ", ".join(sql_rounded(f"{h}(CASE WHEN tk IS NOT NULL THEN {e} END)", n) for n, (h, e) in TOP_K.items()) + " FROM ent GROUP BY trajectory_id"

DYNAMICS = {
    "volatility_mean": "coalesce(avg(moved), 0)",
    "volatility_max": "coalesce(max(moved), 0)",
    "flip_rate": "coalesce(sum(flip), 0) / greatest(count(*) - 1, 1)",
    "mono_viol_rate": "coalesce(sum(rise), 0) / greatest(count(*) - 1, 1)",
    "margin_min": "min(margin)",
    "margin_mean": "avg(margin)",
    "offmass_mean": "coalesce(avg(off), 0)",
    "offmass_slope": "coalesce(CASE WHEN count(off) >= 2 THEN regr_slope(off, k) END, 0)",
}
STEPS = f"""{X.STATES}, st AS (
  SELECT trajectory_id, position, h, dist, lag(dist) OVER w AS was, 1 - mass_capture AS off, row_number() OVER w - 1 AS k,
    list_position(dist, list_max(dist)) AS top, h - lag(h) OVER w AS up
  FROM ent WHERE dist IS NOT NULL WINDOW w AS (PARTITION BY trajectory_id ORDER BY position)
), dy AS (
  SELECT *, list_reverse_sort(dist)[1] - list_reverse_sort(dist)[2] AS margin, CASE WHEN up > 1e-9 THEN 1 WHEN up IS NOT NULL THEN 0 END AS rise,
    CASE WHEN was IS NOT NULL THEN CASE WHEN list_position(was, list_max(was)) <> top THEN 1 ELSE 0 END END AS flip,
    CASE WHEN was IS NOT NULL THEN greatest(0, (SELECT sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 FROM (SELECT unnest(dist) AS p, unnest(was) AS q))) END AS moved
  FROM st
)"""


def _dynamics(name, expression):
    def query(spark, sf_dir):
        return trajectory.dynamics(X.states(spark, sf_dir), X.SPACE).select("trajectory_id", rounded(name))

    QUERIES[name] = query
    ORACLES[name] = f"WITH {STEPS} SELECT trajectory_id, {sql_rounded(expression, name)} FROM dy GROUP BY trajectory_id"


for _name, _sql in DYNAMICS.items():
    _dynamics(_name, _sql)


def _with_truth(spark, sf_dir, columns):
    scores = trajectory.scores(X.states(spark, sf_dir))
    return evaluate.long_scores(scores, X.truth(spark, sf_dir), columns)


def flagship_auc(spark, sf_dir):
    """Which score best predicts wrong outcomes? Sign-aware ROC area of
    mean_entropy."""
    out = evaluate.deferral_auc(_with_truth(spark, sf_dir, ["mean_entropy"]))
    return out.select("score_column", rounded("roc_auc"), rounded("roc_auc_sign_aware"), "direction", "n_pos", "n_neg")


QUERIES["flagship_auc"] = flagship_auc
ORACLES["flagship_auc"] = f"""WITH {PER_TRAJECTORY}, {X.TRUTH}, j AS (
  SELECT mean_entropy AS s, target, rank() OVER (ORDER BY mean_entropy) + (count(*) OVER (PARTITION BY mean_entropy) - 1) / 2.0::DOUBLE AS r FROM tr JOIN truth USING (trajectory_id)),
a AS (SELECT count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n, sum(r) FILTER (target = 1) AS rs FROM j),
b AS (SELECT p, n, (rs - p * (p + 1) / 2.0::DOUBLE) / (p * n) AS auc FROM a)
SELECT 'mean_entropy' AS score_column, {sql_rounded("auc", "roc_auc")}, {sql_rounded("greatest(auc, 1 - auc)", "roc_auc_sign_aware")}, CASE WHEN auc >= 0.5 THEN 'greater' ELSE 'less' END AS direction, p AS n_pos, n AS n_neg FROM b"""


def rank_percentiles(spark, sf_dir):
    """Average-tie rank over n of n_steps (many ties) and mean_entropy."""
    found = trajectory.scores(X.states(spark, sf_dir))
    ranked = rank_percentiles_of(found, "trajectory_id", {"rp_steps": F.col("n_steps"), "rp_entropy": F.round("mean_entropy", 9)})
    return ranked.select("trajectory_id", rounded("rp_steps"), rounded("rp_entropy"))


def _rp(column: str) -> str:
    return f"(rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0::DOUBLE) / count(*) OVER ()"


QUERIES["rank_percentile"] = rank_percentiles
ORACLES["rank_percentile"] = f"WITH {PER_TRAJECTORY} SELECT trajectory_id, {sql_rounded(_rp('n_steps'), 'rp_steps')}, {sql_rounded(_rp('round(mean_entropy, 9)'), 'rp_entropy')} FROM tr"

#: Composites as means of rank percentiles: name -> (column, sign).
COMPOSITES = {
    "corrected_3": (("max_entropy", 1), ("terminal_entropy", 1), ("entropy_plateau", -1)),
    "mass_flipped": (("max_entropy", 1), ("terminal_entropy", 1), ("entropy_plateau", -1), ("mass_capture_mean", -1), ("mass_capture_min", -1)),
    "all_flipped": (("max_entropy", -1), ("terminal_entropy", -1), ("entropy_plateau", 1)),
    "mean_h_only": (("mean_entropy", 1),),
}


def composites(spark, sf_dir):
    """Composite scores; max_entropy stands in for the kNN distance here."""
    rows = trajectory.scores(X.states(spark, sf_dir)).where("n_positions > 0")
    parts = sorted({p for ps in COMPOSITES.values() for p in ps})
    name = lambda p: f"rp_{p[0]}_{'p' if p[1] > 0 else 'm'}"
    ranked = rank_percentiles_of(rows, "trajectory_id", {name(p): F.round(F.col(p[0]) * p[1], 9) + 0.0 for p in parts})
    return ranked.select("trajectory_id", *[rounded(sum((F.col(name(p)) for p in ps), F.lit(0.0)) / len(ps), n) for n, ps in COMPOSITES.items()])


QUERIES["composite_sweep"] = composites
ORACLES["composite_sweep"] = f"WITH {PER_TRAJECTORY}, rp AS (SELECT trajectory_id, " + ", ".join(_rp(f"(round({c} * {s}, 9) + 0.0)") + f" AS rp_{c}_{'p' if s > 0 else 'm'}" for c, s in sorted({p for ps in COMPOSITES.values() for p in ps})) + " FROM tr WHERE n_positions > 0) SELECT trajectory_id, " + ", ".join(
    sql_rounded("(" + " + ".join(f"rp_{c}_{'p' if s > 0 else 'm'}" for c, s in ps) + f") / {len(ps)}", n) for n, ps in COMPOSITES.items()
) + " FROM rp"
