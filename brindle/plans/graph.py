"""Recovered transition graph, its indices, and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import graph as G
from brindle.operators import knn, vector_index
from brindle.plans.common import rounded, sql_rounded
from brindle.sources import artifacts as A
from brindle.sources import fixtures as X
from brindle.sources.store import placed

QUERIES, ORACLES = {}, {}
MIN = 5


def _entropy_sql(source: str, keys: str, name: str) -> str:
    return f"""{name} AS (SELECT {keys}, sum(c) AS n_outcomes, greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c)) AS entropy FROM (SELECT {keys}, outcome, count(*) AS c FROM {source} WHERE outcome IS NOT NULL GROUP BY {keys}, outcome) GROUP BY {keys})"""


BASE = f"""{X.TRANSITIONS}, ad AS (
  SELECT trajectory_id, position, node_id AS source_id, action_id, outcome, lead(node_id) OVER (PARTITION BY trajectory_id ORDER BY position) AS target_id FROM walk
), nx AS (SELECT * FROM ad WHERE target_id IS NOT NULL),
ed AS (SELECT source_id, action_id, target_id, count(*) AS frequency FROM nx GROUP BY 1, 2, 3),
nd AS (SELECT node_id, count(*) AS visit_count FROM walk GROUP BY 1),
dg AS (SELECT node_id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree FROM nd LEFT JOIN (SELECT source_id AS node_id, count(*) AS o FROM ed GROUP BY 1) USING (node_id) LEFT JOIN (SELECT target_id AS node_id, count(*) AS i FROM ed GROUP BY 1) USING (node_id))"""
VOI = f"""{BASE}, {_entropy_sql('walk', 'node_id', 'nh')}, {_entropy_sql('nx', 'source_id, action_id, target_id', 'vh')},
ends AS (SELECT 0 AS k, max(outcome) AS outcome FROM walk GROUP BY trajectory_id), {_entropy_sql('ends', 'k', 'gh')},
pn AS (SELECT node_id, visit_count, CASE WHEN nh.n_outcomes >= {MIN} THEN nh.entropy ELSE gh.entropy END AS prior, CASE WHEN nh.n_outcomes >= {MIN} THEN 'local' ELSE 'global' END AS level FROM nd LEFT JOIN nh USING (node_id), gh),
pe AS (SELECT ed.*, s.prior AS source_h, s.visit_count, CASE WHEN vh.n_outcomes >= {MIN} THEN vh.entropy ELSE t.prior END AS h_t, CASE WHEN vh.n_outcomes >= {MIN} THEN 'local_via_edge' ELSE t.level END AS posterior_level
  FROM ed JOIN vh USING (source_id, action_id, target_id) JOIN pn s ON s.node_id = source_id JOIN pn t ON t.node_id = target_id),
ac AS (SELECT source_id, action_id, round(first(source_h) - sum(frequency * h_t) / sum(frequency), 12) AS voi, sum(frequency) / first(visit_count) AS consensus_rate FROM pe GROUP BY 1, 2),
ct AS (SELECT quantile_cont(voi, 0.75) AS vh, quantile_cont(voi, 0.25) AS vl, quantile_cont(consensus_rate, 0.75) AS rh, quantile_cont(consensus_rate, 0.25) AS rl FROM ac),
kl AS (SELECT source_id, action_id, voi, consensus_rate, CASE WHEN voi >= vh AND consensus_rate >= rh THEN 0 WHEN voi >= vh AND consensus_rate <= rl THEN 1 WHEN voi <= vl AND consensus_rate >= rh THEN 2 WHEN voi <= vl AND consensus_rate <= rl THEN 3 ELSE 4 END AS classification FROM ac, ct)"""


def _steps(spark, sf_dir):
    return X.transitions(spark, sf_dir)


def _graph(spark, sf_dir):
    return G.recover(_steps(spark, sf_dir), G.RecoveryConfig(min_count=MIN))


def visit_table(spark, sf_dir):
    return G.visits(_steps(spark, sf_dir))


QUERIES["visit_seq"] = visit_table
ORACLES["visit_seq"] = f"WITH {X.TRANSITIONS} SELECT row_number() OVER (ORDER BY trajectory_id, position) - 1 AS visit_seq, trajectory_id, position AS timestep, node_id FROM walk"
QUERIES["next_state"] = lambda s, d: G.adjacent(_steps(s, d)).select("trajectory_id", "position", "source_id", "target_id")
ORACLES["next_state"] = f"WITH {BASE} SELECT trajectory_id, position, source_id, target_id FROM ad"
QUERIES["node_visits"] = lambda s, d: _steps(s, d).groupBy("node_id").agg(F.count("*").alias("visit_count"))
ORACLES["node_visits"] = f"WITH {BASE} SELECT * FROM nd"
QUERIES["transitions"] = lambda s, d: G.transitions(_steps(s, d))
ORACLES["transitions"] = f"WITH {BASE} SELECT * FROM ed"
QUERIES["outcome_lists"] = lambda s, d: _steps(s, d).where("outcome is not null").groupBy("node_id", "outcome").agg(F.count("*").alias("n"))
ORACLES["outcome_lists"] = f"WITH {X.TRANSITIONS} SELECT node_id, outcome, count(*) AS n FROM walk WHERE outcome IS NOT NULL GROUP BY 1, 2"
QUERIES["entropy_labels"] = lambda s, d: G.label_entropy(_steps(s, d), ["node_id"]).select("node_id", "n_outcomes", rounded("entropy"))
ORACLES["entropy_labels"] = f"WITH {X.TRANSITIONS}, {_entropy_sql('walk', 'node_id', 'nh')} SELECT node_id, CAST(n_outcomes AS BIGINT) AS n_outcomes, {sql_rounded('entropy', 'entropy')} FROM nh"
QUERIES["prior_entropy"] = lambda s, d: _graph(s, d)[0].select("node_id", "visit_count", "is_terminal", rounded("prior"), "level")
ORACLES["prior_entropy"] = f"WITH {VOI} SELECT node_id, visit_count, out_degree = 0 AS is_terminal, {sql_rounded('prior', 'prior')}, level FROM pn JOIN dg USING (node_id)"
QUERIES["recover_graph"] = lambda s, d: _graph(s, d)[1].select("source_id", "action_id", "target_id", "frequency", rounded("voi"), rounded("consensus_rate"), F.col("classification").cast("int").alias("classification"))
ORACLES["recover_graph"] = f"WITH {VOI} SELECT source_id, action_id, target_id, frequency, {sql_rounded('voi', 'voi')}, {sql_rounded('consensus_rate', 'consensus_rate')}, classification FROM ed JOIN kl USING (source_id, action_id)"
QUERIES["action_voi"] = lambda s, d: _graph(s, d)[1].select("source_id", "action_id", rounded("voi"), rounded("consensus_rate")).distinct()
ORACLES["action_voi"] = f"WITH {VOI} SELECT source_id, action_id, {sql_rounded('voi', 'voi')}, {sql_rounded('consensus_rate', 'consensus_rate')} FROM kl"
QUERIES["edge_class"] = lambda s, d: _graph(s, d)[1].groupBy(F.col("classification").cast("int").alias("classification")).agg(F.count("*").alias("n"))
ORACLES["edge_class"] = f"WITH {VOI} SELECT classification, count(*) AS n FROM ed JOIN kl USING (source_id, action_id) GROUP BY 1"
QUERIES["voi_summary"] = lambda s, d: _graph(s, d)[1].groupBy("posterior_level").agg(F.count("*").alias("n"))
ORACLES["voi_summary"] = f"WITH {VOI} SELECT posterior_level, count(*) AS n FROM pe GROUP BY 1"
QUERIES["degrees"] = lambda s, d: G.degrees(*_pair(s, d))
ORACLES["degrees"] = f"WITH {BASE} SELECT * FROM dg"


def _pair(spark, sf_dir):
    steps = _steps(spark, sf_dir)
    return steps.select("node_id").distinct(), G.transitions(steps)


QUERIES["density"] = lambda s, d: G.density(*_pair(s, d)).select("n_nodes", "n_edges", rounded("mean_out_degree"), rounded("median_out_degree"), "max_out_degree", rounded("terminal_fraction"))
ORACLES["density"] = f"WITH {BASE} SELECT count(*) AS n_nodes, CAST(sum(out_degree) AS BIGINT) AS n_edges, {sql_rounded('avg(out_degree)', 'mean_out_degree')}, {sql_rounded('quantile_cont(out_degree, 0.5)', 'median_out_degree')}, max(out_degree) AS max_out_degree, {sql_rounded('avg(CASE WHEN out_degree = 0 THEN 1 ELSE 0 END)', 'terminal_fraction')} FROM dg"
QUERIES["terminal_nodes"] = lambda s, d: G.terminal_nodes(*_pair(s, d))
ORACLES["terminal_nodes"] = f"WITH {BASE} SELECT node_id FROM dg WHERE out_degree = 0"
QUERIES["roots"] = lambda s, d: G.roots(*_pair(s, d))
ORACLES["roots"] = f"WITH {BASE} SELECT node_id FROM dg WHERE in_degree = 0"
LOOKUP = "('view@0'), ('click@3'), ('nowhere@0')"


def _wanted(spark):
    return spark.createDataFrame([("view@0",), ("click@3",), ("nowhere@0",)], "node_id string")


def graph_lookup(spark, sf_dir):
    """Whether the graph has nodes, with their out and in edges counted by the
    lookups."""
    nodes, edges = _pair(spark, sf_dir)
    wanted = _wanted(spark)
    counted = lambda found, side, name: found.groupBy(F.col(side).alias("node_id")).agg(F.sum("frequency").alias(name))
    out = G.has_node(nodes, wanted).join(counted(G.out_edges(edges, wanted), "source_id", "left_by"), "node_id", "left")
    return out.join(counted(G.in_edges(edges, wanted), "target_id", "reached_by"), "node_id", "left").fillna(0, ["left_by", "reached_by"])


QUERIES["graph_lookup"] = graph_lookup
ORACLES["graph_lookup"] = f"WITH {BASE}, w(node_id) AS (VALUES {LOOKUP}) SELECT node_id, node_id IN (SELECT node_id FROM nd) AS known, CAST(coalesce((SELECT sum(frequency) FROM ed WHERE source_id = w.node_id), 0) AS BIGINT) AS left_by, CAST(coalesce((SELECT sum(frequency) FROM ed WHERE target_id = w.node_id), 0) AS BIGINT) AS reached_by FROM w"
QUERIES["edges_by_class"] = lambda s, d: G.edges_by_class(_graph(s, d)[1], G.CONSENSUS).select("source_id", "action_id", "target_id", "frequency")
ORACLES["edges_by_class"] = f"WITH {VOI} SELECT source_id, action_id, target_id, frequency FROM ed JOIN kl USING (source_id, action_id) WHERE classification = 0"


def outcomes_per_edge(spark, sf_dir):
    return G.adjacent(_steps(spark, sf_dir)).where("target_id is not null").groupBy("source_id", "action_id", "target_id", "outcome").agg(F.count("*").alias("n"))


QUERIES["outcomes_per_edge"] = outcomes_per_edge
ORACLES["outcomes_per_edge"] = f"WITH {BASE} SELECT source_id, action_id, target_id, outcome, count(*) AS n FROM nx GROUP BY ALL"
QUERIES["outcomes_overall"] = lambda s, d: _steps(s, d).groupBy("trajectory_id").agg(F.max("outcome").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))
ORACLES["outcomes_overall"] = f"WITH {VOI} SELECT outcome, count(*) AS n FROM ends GROUP BY 1"
QUERIES["f_edge_frequency"] = lambda s, d: G.transitions(_steps(s, d)).where("frequency >= 3 and source_id <> target_id")
ORACLES["f_edge_frequency"] = f"WITH {BASE} SELECT * FROM ed WHERE frequency >= 3 AND source_id <> target_id"
QUERIES["voi_flatness"] = lambda s, d: G.voi_flatness(_steps(s, d), _graph(s, d)[1].where("frequency > 1")).select("trajectory_id", rounded("voi_flatness"))
ORACLES["voi_flatness"] = f"""WITH {VOI}, ge AS (SELECT source_id, action_id, target_id, abs(voi) AS gain FROM ed JOIN kl USING (source_id, action_id) WHERE frequency > 1)
SELECT trajectory_id, {sql_rounded('coalesce(avg(CASE WHEN ad.target_id IS NOT NULL THEN coalesce(gain, (SELECT max(gain) FROM ge)) END), 0)', 'voi_flatness')} FROM ad LEFT JOIN ge USING (source_id, action_id, target_id) GROUP BY 1"""


def assembly(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return G.assembly_indices(nodes, edges).withColumn("n_paths", F.col("n_paths").cast("long"))


QUERIES["assembly_indices"] = assembly
ORACLES["assembly_indices"] = f"""WITH RECURSIVE {VOI.lstrip()}, ar AS (
  SELECT source_id, target_id, count(*) AS parallel, min(CASE classification WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 2.0 WHEN 2 THEN 3.0 WHEN 3 THEN 5.0 ELSE 2.0 END) AS weight FROM ed JOIN kl USING (source_id, action_id) GROUP BY 1, 2),
lv AS (
  SELECT node_id, 0 AS steps, 1::BIGINT AS n_paths, 0::DOUBLE AS cost FROM dg WHERE in_degree = 0
  UNION ALL
  SELECT target_id, any_value(steps) + 1, CAST(sum(n_paths * parallel) AS BIGINT), min(cost + weight) FROM lv JOIN ar ON ar.source_id = lv.node_id GROUP BY target_id)
SELECT node_id, s.steps AS assembly_index_unweighted, s.cost AS assembly_index_weighted, coalesce(p.n_paths, 0) AS n_paths
FROM nd LEFT JOIN (SELECT node_id, min(steps) AS steps, min(cost) AS cost FROM lv GROUP BY 1) s USING (node_id)
LEFT JOIN lv p USING (node_id) WHERE p.steps IS NULL OR p.steps = s.steps"""


def nearest(spark, sf_dir):
    v = X.visits(spark, sf_dir)
    return knn.nearest(v, v, 5).select("query_seq", "timestep", "visit_seq", rounded("similarity"), "rank")


KNN = """sm AS (SELECT a.vec_id AS query_seq, a.label AS timestep, b.vec_id AS visit_seq, round(list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * CAST(b.embedding[i] AS DOUBLE))), 9) AS similarity
  FROM embeddings a JOIN embeddings b ON a.label = b.label),
kn AS (SELECT *, row_number() OVER (PARTITION BY query_seq ORDER BY similarity DESC, visit_seq) AS rank FROM sm)"""
QUERIES["join_knn"] = nearest
ORACLES["join_knn"] = f"WITH {KNN} SELECT query_seq, timestep, visit_seq, {sql_rounded('similarity', 'similarity')}, rank FROM kn WHERE rank <= 5"


def nearest_by_index(spark, sf_dir):
    """bld_vec, snk_vec, src_vec: an index of small leaves is saved, read back
    and searched."""
    v, path = X.visits(spark, sf_dir), placed(spark, "vector-index")
    A.save_index(vector_index.build(v, leaf=16), path)
    return vector_index.search(A.load_index(spark, path), v, 5).select("query_seq", "timestep", "visit_seq", rounded("similarity"), "rank")


QUERIES["knn_index"] = nearest_by_index
ORACLES["knn_index"] = ORACLES["join_knn"]


def distance(spark, sf_dir):
    v = X.visits(spark, sf_dir)
    return knn.distance_from_trajectory(v.withColumn("trajectory_id", F.pmod("visit_seq", F.lit(50))), v, k=5).select("trajectory_id", rounded("distance_from_trajectory"))


QUERIES["distance_from_trajectory"] = distance
ORACLES["distance_from_trajectory"] = f"WITH {KNN}, ds AS (SELECT query_seq, 1 - avg(similarity) AS d FROM kn WHERE rank <= 5 GROUP BY 1) SELECT query_seq % 50 AS trajectory_id, {sql_rounded('max(d)', 'distance_from_trajectory')} FROM ds GROUP BY 1"
