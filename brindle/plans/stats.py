"""Statistics, joins and set operations on the fixture views."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import uncertainty as U
from brindle.operators import resample as R
from brindle.operators import stats as S
from brindle.operators import trajectory
from brindle.operators.evaluate import auc_with_ci, deferral_auc
from brindle.operators.ordered import quantiles
from brindle.plans.common import rounded, sql_rounded
from brindle.plans.evaluation import CELLS, cells, doc_long
from brindle.plans.scores import PER_TRAJECTORY
from brindle.sources import fixtures as X
from brindle.sources import questions as Q
from brindle.sources.store import cut_lineage

QUERIES, ORACLES = {}, {}
RANKS = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE"


def spearman(spark, sf_dir):
    return S.spearman(cells(spark, sf_dir), "trajectory_id", "me", "js").select(rounded("rho"), "n")


QUERIES["spearman"] = spearman
ORACLES["spearman"] = f"WITH {CELLS}, r AS (SELECT {RANKS.format('me')} AS a, {RANKS.format('js')} AS b FROM cl) SELECT {sql_rounded('corr(a, b)', 'rho')}, count(*) AS n FROM r"


def spearman_matrix(spark, sf_dir):
    return S.spearman_matrix(cells(spark, sf_dir), "trajectory_id", ["me", "js", "target"]).select("a", "b", rounded("rho"))


QUERIES["spearman_matrix"] = spearman_matrix
ORACLES["spearman_matrix"] = f"WITH {CELLS}, r AS (SELECT {RANKS.format('me')} AS a, {RANKS.format('js')} AS b, {RANKS.format('target')} AS c FROM cl) SELECT 'me' AS a, 'js' AS b, {sql_rounded('corr(a, b)', 'rho')} FROM r UNION ALL SELECT 'me', 'target', round(corr(a, c), 6) + 0.0 FROM r UNION ALL SELECT 'js', 'target', round(corr(b, c), 6) + 0.0 FROM r"


def _docs(spark, sf_dir):
    return X.doc_scores(spark, sf_dir)


QUERIES["cohen_d"] = lambda s, d: S.cohen_d(_docs(s, d), "score").select(rounded("d"), "n0", "n1")
ORACLES["cohen_d"] = f"""WITH {X.DOC_SCORES}, a AS (SELECT avg(score) FILTER (target = 0) AS m0, avg(score) FILTER (target = 1) AS m1, var_samp(score) FILTER (target = 0) AS v0, var_samp(score) FILTER (target = 1) AS v1, count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM scored)
SELECT {sql_rounded('(m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2))', 'd')}, n0, n1 FROM a"""
QUERIES["mann_whitney"] = lambda s, d: S.mann_whitney(_docs(s, d), "score").select("u", "n1", "n0", rounded("z"), F.round("p", 5).alias("p"))
ORACLES["mann_whitney"] = f"""WITH {X.DOC_SCORES}, r AS (SELECT target, {RANKS.format('score')} AS r FROM scored), t AS (SELECT sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT count(*) AS c FROM scored GROUP BY score)),
a AS (SELECT sum(r) FILTER (target = 1) - count(*) FILTER (target = 1) * (count(*) FILTER (target = 1) + 1) / 2.0::DOUBLE AS u, count(*) FILTER (target = 1) AS n1, count(*) FILTER (target = 0) AS n0 FROM r),
z AS (SELECT u, n1, n0, greatest(abs(u - n1 * n0 / 2.0::DOUBLE) - 0.5, 0) / sqrt(n1 * n0 / 12.0::DOUBLE * (n1 + n0 + 1 - ties / ((n1 + n0) * (n1 + n0 - 1)))) AS z FROM a, t)
SELECT u, n1, n0, {sql_rounded('z', 'z')}, round(2 * (SELECT sum(exp(-((z + k * 0.001 + 0.0005) * (z + k * 0.001 + 0.0005)) / 2) * 0.001) / sqrt(2 * pi()) FROM range(0, 9000) q(k)), 5) AS p FROM z"""
QUERIES["ks_2samp"] = lambda s, d: S.ks_two_sample(_docs(s, d), "score").select(rounded("d"), "n1", "n0", rounded("p_limit"))
ORACLES["ks_2samp"] = f"""WITH {X.DOC_SCORES}, g AS (SELECT score, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS n FROM scored GROUP BY score),
c AS (SELECT sum(p) OVER (ORDER BY score) / (SELECT sum(p) FROM g) AS a, sum(n) OVER (ORDER BY score) / (SELECT sum(n) FROM g) AS b FROM g),
m AS (SELECT max(abs(a - b)) AS d, (SELECT CAST(sum(p) AS BIGINT) FROM g) AS n1, (SELECT CAST(sum(n) AS BIGINT) FROM g) AS n0 FROM c),
x AS (SELECT *, d * sqrt(n1::DOUBLE * n0 / (n1 + n0)) AS x FROM m)
SELECT {sql_rounded('d', 'd')}, n1, n0, {sql_rounded('CASE WHEN x < 0.2 THEN 1 ELSE (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0 * k * k * x * x)) FROM range(1, 101) t(k)) END', 'p_limit')} FROM x"""
QUERIES["ecdf"] = lambda s, d: S.ecdf(_docs(s, d), "score").select("score", rounded("share"))
ORACLES["ecdf"] = f"WITH {X.DOC_SCORES} SELECT DISTINCT score, {sql_rounded('count(*) OVER (ORDER BY score) / count(*) OVER ()', 'share')} FROM scored"
QUERIES["standardize"] = lambda s, d: S.standardized(_docs(s, d), ["score"]).select("doc_id", rounded("z_score"))
ORACLES["standardize"] = f"WITH {X.DOC_SCORES} SELECT doc_id, {sql_rounded('(score - avg(score) OVER ()) / stddev_pop(score) OVER ()', 'z_score')} FROM scored"


def interaction(spark, sf_dir):
    z = S.standardized(cells(spark, sf_dir).select("trajectory_id", "me", "js"), ["me", "js"])
    return z.select("trajectory_id", rounded("z_me"), rounded("z_js"), rounded(F.col("z_me") * F.col("z_js"), "z_both"))


QUERIES["interaction_term"] = interaction
_ZM, _ZJ = ("(me - avg(me) OVER ()) / stddev_pop(me) OVER ()", "(js - avg(js) OVER ()) / stddev_pop(js) OVER ()")
ORACLES["interaction_term"] = f"WITH {CELLS} SELECT trajectory_id, {sql_rounded(_ZM, 'z_me')}, {sql_rounded(_ZJ, 'z_js')}, {sql_rounded(f'({_ZM}) * ({_ZJ})', 'z_both')} FROM cl"


def quantile(spark, sf_dir):
    return quantiles(_docs(spark, sf_dir), ["lang"], "score", {"q10": 0.1, "q50": 0.5, "q90": 0.9}).select("lang", rounded("q10"), rounded("q50"), rounded("q90"))


QUERIES["quantile"] = quantile
ORACLES["quantile"] = f"WITH {X.DOC_SCORES} SELECT lang, " + ", ".join(sql_rounded(f"quantile_cont(score, {q})", n) for n, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9))) + " FROM scored GROUP BY lang"


def mass_shape(spark, sf_dir):
    """Per class: mean, median and population sd of mass capture."""
    s = X.states(spark, sf_dir).where("mass_capture is not null").join(X.truth(spark, sf_dir), "trajectory_id").select("target", F.round("mass_capture", 9).alias("m"))
    base = s.groupBy("target").agg(F.count("*").alias("n"), F.min("m").alias("least"), F.max("m").alias("most"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"))
    return base.join(quantiles(s, ["target"], "m", {"median": 0.5}), "target").select("target", "n", *[rounded(c) for c in ("least", "most", "mean", "sd", "median")])


QUERIES["mass_shape"] = mass_shape
ORACLES["mass_shape"] = f"""WITH {X.STATES}, {X.TRUTH}, m AS (SELECT target, round(mass_capture, 9) AS m FROM states JOIN truth USING (trajectory_id) WHERE mass_capture IS NOT NULL)
SELECT target, count(*) AS n, {sql_rounded('min(m)', 'least')}, {sql_rounded('max(m)', 'most')}, {sql_rounded('avg(m)', 'mean')}, {sql_rounded('stddev_pop(m)', 'sd')}, {sql_rounded('quantile_cont(m, 0.5)', 'median')} FROM m GROUP BY target"""


def mass_shape_tests(spark, sf_dir):
    """How the classes' mean mass capture differs: means, medians, d, rank and
    distribution tests."""
    m = trajectory.scores(X.states(spark, sf_dir)).select("trajectory_id", F.round("mass_capture_mean", 9).alias("score")).join(X.truth(spark, sf_dir), "trajectory_id").withColumn("key", F.lit(0))
    m = cut_lineage(m, "mass")
    med = lambda t, name: quantiles(m.where(F.col("target") == t), ["key"], "score", {name: 0.5})
    at = lambda df, *columns: df.select(F.lit(0).alias("key"), *columns)
    base = m.groupBy("key").agg((F.avg(F.when(F.col("target") == 1, F.col("score"))) - F.avg(F.when(F.col("target") == 0, F.col("score")))).alias("delta_mean"))
    out = base.join(med(1, "m1"), "key").join(med(0, "m0"), "key").join(at(S.cohen_d(m, "score"), "d", "n0", "n1"), "key")
    out = out.join(at(S.mann_whitney(m, "score"), "u", "z"), "key").join(at(S.ks_two_sample(m, "score"), F.col("d").alias("ks"), "p_limit"), "key")
    return out.select("n0", "n1", rounded("delta_mean"), rounded(F.col("m1") - F.col("m0"), "delta_median"), rounded("d"), "u", rounded("z"), rounded("ks"), rounded("p_limit"))


def codec_stats(spark, sf_dir):
    """js on the agreeing and right subset: mean, median, sd, p10, p90."""
    r = cells(spark, sf_dir).where("target = 0")
    return r.groupBy("key").agg(F.count("*").alias("n"), F.avg("js").alias("mean"), F.stddev_pop("js").alias("sd")).join(quantiles(r, ["key"], "js", {"median": 0.5, "p10": 0.1, "p90": 0.9}), "key").select("n", *[rounded(c) for c in ("mean", "sd", "median", "p10", "p90")])


QUERIES["codec_subset_stats"] = codec_stats
ORACLES["codec_subset_stats"] = f"WITH {CELLS} SELECT count(*) AS n, {sql_rounded('avg(js)', 'mean')}, {sql_rounded('stddev_pop(js)', 'sd')}, {sql_rounded('quantile_cont(js, 0.5)', 'median')}, {sql_rounded('quantile_cont(js, 0.1)', 'p10')}, {sql_rounded('quantile_cont(js, 0.9)', 'p90')} FROM cl WHERE target = 0"


def agreement(spark, sf_dir):
    """Two adapters' entropies: rates within tolerances, nearest-rank P95."""
    st = X.states(spark, sf_dir).where("distribution is not null and size(top_k) > 1")
    d = st.select(F.round(F.abs(U.gap_top2(F.col("top_k")) - F.col("mass_capture")), 9).alias("d")).withColumn("key", F.lit(0))
    from brindle.operators.ordered import ordered_sums

    groups = ordered_sums(d.groupBy("key", "d").agg(F.count("*").alias("n")), ["key"], "d", ["n"])
    # One row, which is the side to be sent; the distinct values stay where they are.
    total = d.agg(F.count("*").alias("total"), F.avg((F.col("d") <= 0.5).cast("int")).alias("within_half"), F.avg((F.col("d") <= 0.9).cast("int")).alias("within_most"))
    place = F.bround(0.95 * (F.col("total") - 1))
    hit = (F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n"))
    return groups.join(F.broadcast(total), F.col("before_n") <= F.col("total")).where(hit).select("total", rounded("within_half"), rounded("within_most"), rounded("d", "p95"))


QUERIES["agreement"] = agreement
ORACLES["agreement"] = f"""WITH {X.STATES}, d AS (SELECT round(abs(exp(tk[1]) - exp(tk[2]) - mass_capture), 9) AS d FROM states WHERE dist IS NOT NULL AND len(tk) > 1),
s AS (SELECT list_sort(list(d)) AS l, count(*) AS n, avg(CASE WHEN d <= 0.5 THEN 1 ELSE 0 END) AS a, avg(CASE WHEN d <= 0.9 THEN 1 ELSE 0 END) AS b FROM d)
SELECT n AS total, {sql_rounded('a', 'within_half')}, {sql_rounded('b', 'within_most')}, {sql_rounded('l[CAST(round_even(0.95::DOUBLE * (n - 1), 0) AS INT) + 1]', 'p95')} FROM s"""


# Joins and set operations.
def join_left(spark, sf_dir):
    d, l = X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "labels")
    return d.select("doc_id").join(l.select("doc_id", "quality"), "doc_id", "left")


QUERIES["join_left_b"] = join_left
ORACLES["join_left_b"] = "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)"


def join_analysis(spark, sf_dir):
    d, l, b = X.table(spark, sf_dir, "documents"), X.table(spark, sf_dir, "labels"), X.table(spark, sf_dir, "embeddings")
    return d.select("doc_id", "lang").join(l, "doc_id").join(b.select(F.col("vec_id").alias("doc_id"), "label"), "doc_id").select("doc_id", "lang", "quality", "toxic", "label")


QUERIES["join_analysis"] = join_analysis
ORACLES["join_analysis"] = "SELECT doc_id, lang, quality, toxic, label FROM documents JOIN labels USING (doc_id) JOIN embeddings ON vec_id = doc_id"


def join_lookup(spark, sf_dir):
    """A dict lookup: of repeated keys the last (largest value) wins."""
    looked = X.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max_by("role", "turn").alias("role"))
    return X.table(spark, sf_dir, "documents").select("doc_id").join(looked, "doc_id", "left").where("role is not null")


QUERIES["join_lookup"] = join_lookup
ORACLES["join_lookup"] = "SELECT doc_id, role FROM documents JOIN (SELECT conv_id AS doc_id, arg_max(role, turn) AS role FROM conversations GROUP BY 1) USING (doc_id)"
QUERIES["join_semi_stratum"] = lambda s, d: X.table(s, d, "documents").select("doc_id", "lang").join(X.table(s, d, "labels").where("toxic = 1"), "doc_id", "left_semi")
ORACLES["join_semi_stratum"] = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"
QUERIES["join_anti_resume"] = lambda s, d: X.table(s, d, "documents").select("doc_id").join(X.table(s, d, "labels"), "doc_id", "left_anti")
ORACLES["join_anti_resume"] = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def zip_agreement(spark, sf_dir):
    """Two snapshots of the same walks aligned by (trajectory, position); the
    shorter one rules. The other one has other buckets and six steps."""
    t = X.transitions(spark, sf_dir)
    other = F.when(F.col("value") < 6, "lo").when(F.col("value") < 15, "mid").otherwise("hi")
    b = t.where("position < 6").select("trajectory_id", "position", other.alias("other"))
    return t.join(b, ["trajectory_id", "position"]).select("trajectory_id", "position", (F.col("action_id") == F.col("other")).alias("same"))


QUERIES["zip_agreement"] = zip_agreement
ORACLES["zip_agreement"] = f"WITH {X.TRANSITIONS} SELECT trajectory_id, position, action_id = CASE WHEN value < 6 THEN 'lo' WHEN value < 15 THEN 'mid' ELSE 'hi' END AS same FROM walk WHERE position < 6"


def join_pairs(spark, sf_dir):
    """Mean JS of all replicate pairs i < j within a state."""
    s = X.states(spark, sf_dir).where("distribution is not null")
    p = U.projected(F.col("distribution"), X.SPACE)
    copies = F.array(p, F.array(*[F.lit(1 / 3)] * 3), F.transform(p, lambda x: (x + 1 / 3) / 2))
    return s.select("trajectory_id", "position", rounded(U.mean_pairwise(copies, U.js_divergence), "spread"))


QUERIES["join_pairs"] = join_pairs
_JS = "(SELECT sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2 FROM (SELECT unnest({0}) AS p, unnest({1}) AS q))"
_U, _M = "[1.0::DOUBLE/3, 1.0::DOUBLE/3, 1.0::DOUBLE/3]", "list_transform(dist, lambda x: (x + 1.0::DOUBLE/3) / 2)"
ORACLES["join_pairs"] = f"WITH {X.STATES} SELECT trajectory_id, position, {sql_rounded('(' + _JS.format('dist', _U) + ' + ' + _JS.format('dist', _M) + ' + ' + _JS.format(_U, _M) + ') / 3', 'spread')} FROM states WHERE dist IS NOT NULL"


def union_all(spark, sf_dir):
    parts = [X.table(spark, sf_dir, t).select(F.col(c).alias("id"), F.lit(t).alias("source")) for t, c in (("pages", "page_id"), ("benchmark", "item_id"))]
    return parts[0].unionByName(parts[1]).groupBy("source").agg(F.count("*").alias("n"), F.max("id").alias("top"))


QUERIES["union_all"] = union_all
ORACLES["union_all"] = "SELECT 'pages' AS source, count(*) AS n, max(page_id) AS top FROM pages UNION ALL SELECT 'benchmark', count(*), max(item_id) FROM benchmark"


def limit_records(spark, sf_dir):
    """The first 25 records: what the operator is about."""
    return Q.first_records(X.table(spark, sf_dir, "documents").select("doc_id", "lang"), 25, "doc_id")


QUERIES["limit_records"] = limit_records
ORACLES["limit_records"] = "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25"


def metadata_diff(spark, sf_dir):
    """Keys that only one of two maps has, and keys whose values differ."""
    e = X.table(spark, sf_dir, "events")
    m = F.from_json("props", "map<string,string>")
    other = F.create_map(F.lit("k"), F.lit("1"), F.lit("z"), F.lit("2"))
    changed = F.filter(F.array_intersect(F.map_keys("m"), F.map_keys("o")), lambda k: F.element_at("m", k) != F.element_at("o", k))
    d = e.select("event_id", m.alias("m"), other.alias("o"))
    return d.select("event_id", F.array_join(F.array_sort(F.concat(F.array_except(F.map_keys("m"), F.map_keys("o")), F.array_except(F.map_keys("o"), F.map_keys("m")), changed)), ",").alias("keys"))


QUERIES["metadata_diff"] = metadata_diff
ORACLES["metadata_diff"] = "SELECT event_id, CASE WHEN json_extract_string(props, '$.k') = '1' THEN 'z' ELSE 'k,z' END AS keys FROM events"


QUERIES["mass_shape_tests"] = mass_shape_tests
_INNER = lambda name: ORACLES[name].replace(f"WITH {X.DOC_SCORES}, ", "WITH ")
ORACLES["mass_shape_tests"] = f"""WITH {PER_TRAJECTORY}, {X.TRUTH}, scored AS (SELECT round(mass_capture_mean, 9) AS score, target FROM tr JOIN truth USING (trajectory_id)),
b AS (SELECT avg(score) FILTER (target = 1) - avg(score) FILTER (target = 0) AS dm, quantile_cont(score, 0.5) FILTER (target = 1) - quantile_cont(score, 0.5) FILTER (target = 0) AS md FROM scored)
SELECT e.n0, e.n1, {sql_rounded('dm', 'delta_mean')}, {sql_rounded('md', 'delta_median')}, e.d, u.u, u.z, k.d AS ks, k.p_limit FROM b, ({_INNER('cohen_d')}) e, ({_INNER('mann_whitney')}) u, ({_INNER('ks_2samp')}) k"""


# Resampling and models: rows only.
def bootstrap_ci(spark, sf_dir):
    """Raw, sign-aware and PR intervals, turned in the point's direction."""
    return deferral_auc(doc_long(spark, sf_dir), compute_ci=True)


def auc_interval(spark, sf_dir):
    return auc_with_ci(doc_long(spark, sf_dir))


def boot_auc_folded(spark, sf_dir):
    long = doc_long(spark, sf_dir)
    found = R.intervals(R.bootstrap_areas(long, ["score_column"]), deferral_auc(long), ["score_column"])
    return found.select("score_column", F.col("roc_auc_folded_ci_low").alias("lo"), F.col("roc_auc_folded_ci_high").alias("hi"), F.col("n_replicates").alias("n"))


def paired_bootstrap(spark, sf_dir):
    return R.percentile_interval(R.paired_bootstrap(cells(spark, sf_dir), "trajectory_id", "me", "js"), "delta")


def spearman_interval(spark, sf_dir):
    rows = cells(spark, sf_dir)
    found = R.percentile_interval(R.spearman_bootstrap(rows, "trajectory_id", "me", "js"), "rho").select(F.lit(0).alias("key"), "lo", "hi", F.col("n").alias("n_replicates"))
    return S.spearman(rows, "trajectory_id", "me", "js").withColumn("key", F.lit(0)).join(found, "key").drop("key")


def _fold():
    return F.pmod("trajectory_id", F.lit(5)).cast("int")


def cv_logistic(spark, sf_dir):
    rows = S.standardized(cells(spark, sf_dir), ["me", "js"]).withColumn("fold", _fold())
    return S.cv_logistic(rows.select("trajectory_id", "z_me", "z_js", "target", "fold"), ["z_me", "z_js"]).select("trajectory_id", rounded("oof"))


def interaction_models(spark, sf_dir):
    """Out-of-fold areas of M0 (entropy), M1 (and divergence) and M2 (and their
    product)."""
    z = S.standardized(cells(spark, sf_dir), ["me", "js"]).withColumn("z_both", F.col("z_me") * F.col("z_js")).withColumn("fold", _fold())
    rows = z.select("trajectory_id", "z_me", "z_js", "z_both", "target", "fold")
    found = S.cv_areas(rows, {"M0": ["z_me"], "M1": ["z_me", "z_js"], "M2": ["z_me", "z_js", "z_both"]})
    return found.select("model", "n_features", rounded("roc_auc"), rounded("roc_auc_sign_aware"), "direction")


#: Twelve Newton steps for each fold and model, the 4 x 4 systems by LDL.
_X = ("1.0::DOUBLE", "zm", "zj * (n > 1)::INT", "zm * zj * (n > 2)::INT")
_H = ", ".join(f"sum(w * {_X[i]} * {_X[j]}) + {f'1' if i == j and i else '0'} AS h{i}{j}" for i in range(4) for j in range(i, 4))
_G = ", ".join(f"sum((p - t) * {_X[i]}) + any_value(b{i}) * {int(i > 0)} AS g{i}" for i in range(4))
FITS = f"""zs AS (SELECT trajectory_id, target AS t, trajectory_id % 5 AS fold, {_ZM} AS zm, {_ZJ} AS zj FROM cl),
ft(it, n, f, b0, b1, b2, b3) AS (
  SELECT 0, n, f, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM range(1, 4) a(n), range(0, 5) b(f)
  UNION ALL
  SELECT it + 1, n, f, b0 - s0, b1 - s1, b2 - s2, b3 - s3 FROM (SELECT *, z0 - l10 * s1 - l20 * s2 - l30 * s3 AS s0 FROM (SELECT *, z1 - l21 * s2 - l31 * s3 AS s1 FROM (SELECT *, z2 - l32 * s3 AS s2 FROM (
    SELECT *, (g3 - l30 * y0 - l31 * y1 - l32 * y2) / (h33 - l30 * l30 * d0 - l31 * l31 * d1 - l32 * l32 * d2) AS s3, y0 / d0 AS z0, y1 / d1 AS z1, y2 / d2 AS z2 FROM (
    SELECT *, (h23 - l30 * l20 * d0 - l31 * l21 * d1) / d2 AS l32, g2 - l20 * y0 - l21 * y1 AS y2 FROM (
    SELECT *, h22 - l20 * l20 * d0 - l21 * l21 * d1 AS d2 FROM (
    SELECT *, (h12 - l20 * l10 * d0) / d1 AS l21, (h13 - l30 * l10 * d0) / d1 AS l31, g1 - l10 * y0 AS y1 FROM (
    SELECT *, h11 - l10 * l10 * d0 AS d1 FROM (
    SELECT *, h00 AS d0, h01 / h00 AS l10, h02 / h00 AS l20, h03 / h00 AS l30, g0 AS y0 FROM (
    SELECT it, n, f, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, any_value(b3) AS b3, {_G}, {_H} FROM (
      SELECT *, p * (1 - p) AS w FROM (SELECT ft.*, t, zm, zj, 1 / (1 + exp(-(b0 + b1 * {_X[1]} + b2 * {_X[2]} + b3 * {_X[3]}))) AS p FROM ft JOIN zs ON fold <> f WHERE it < 12))
    GROUP BY it, n, f))))))))))),
oof AS (SELECT n, trajectory_id, t, round(1 / (1 + exp(-(b0 + b1 * {_X[1]} + b2 * {_X[2]} + b3 * {_X[3]}))), 12) AS oof FROM zs JOIN ft ON f = fold AND it = 12)"""
ORACLES["cv_logistic"] = f"WITH RECURSIVE {CELLS.lstrip()}, {FITS} SELECT trajectory_id, {sql_rounded('oof', 'oof')} FROM oof WHERE n = 2"
ORACLES["interaction_models"] = f"""WITH RECURSIVE {CELLS.lstrip()}, {FITS},
rk AS (SELECT n, t, rank() OVER (PARTITION BY n ORDER BY oof) + (count(*) OVER (PARTITION BY n, oof) - 1) / 2 AS r FROM oof),
ar AS (SELECT n, (sum(r) FILTER (t = 1) - count(*) FILTER (t = 1) * (count(*) FILTER (t = 1) + 1) / 2) / (count(*) FILTER (t = 1) * count(*) FILTER (t = 0)) AS a FROM rk GROUP BY 1)
SELECT 'M' || (n - 1) AS model, CAST(n AS INT) AS n_features, {sql_rounded('a', 'roc_auc')}, {sql_rounded('greatest(a, 1 - a)', 'roc_auc_sign_aware')}, CASE WHEN a >= 0.5 THEN 'greater' ELSE 'less' END AS direction FROM ar"""


def perturb(spark, sf_dir):
    s = X.states(spark, sf_dir).where("distribution is not null").select("trajectory_id", "position", U.projected(F.col("distribution"), X.SPACE).alias("p"))
    return S.perturb_disagree(s, "p", 0.5).select("trajectory_id", "position", "perturb_disagree")


QUERIES |= {"bootstrap_ci": bootstrap_ci, "auc_with_ci": auc_interval, "spearman_ci": spearman_interval, "boot_auc_folded": boot_auc_folded, "paired_bootstrap": paired_bootstrap, "cv_logistic": cv_logistic, "interaction_models": interaction_models, "perturb_disagree": perturb}
