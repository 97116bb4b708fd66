"""Artifacts written and read again, question sources, logs and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import evaluate, graph, guards, trajectory
from brindle.plans.common import rounded, sql_rounded
from brindle.plans.graph import BASE, _graph, assembly
from brindle.plans.scores import PER_TRAJECTORY
from brindle.sources import artifacts as A
from brindle.sources import fixtures as X
from brindle.sources import questions as Q
from brindle.sources.store import cut_lineage, placed

QUERIES, ORACLES = {}, {}


def _artifact(spark, sf_dir):
    """The fixture's states as cached trajectories: JSON columns, positions,
    actions, and whole trajectories only."""
    s = X.states(spark, sf_dir).select(
        F.col("trajectory_id").cast("string").alias("trajectory_id"),
        "position",
        F.concat_ws("@", "status", F.col("position").cast("string")).alias("node_id"),
        F.col("position").alias("timestep"),
        F.to_json("distribution").alias("hypothesis_distribution_json"),
        F.col("mass_capture").cast("float").alias("mass_capture"),
        F.to_json(F.create_map(F.lit("priority"), F.col("priority"))).alias("metadata_json"),
        F.when(F.col("position") % 2 == 0, F.col("priority")).alias("action_id_to_next"),
    )
    t = X.truth(spark, sf_dir).select(F.col("trajectory_id").cast("string").alias("trajectory_id"), F.col("target").cast("string").alias("primary_label"), F.lit(1.0).alias("confidence"), F.lit('{"k": "v"}').alias("secondary_labels_json"))
    return t.join(s.groupBy("trajectory_id").agg(F.count("*").cast("int").alias("n_states")), "trajectory_id"), s


def cached_trajectories(spark, sf_dir):
    """snk_cached_traj, src_cached_traj, src_row_decoders, src_prerecovered."""
    path = placed(spark, "trajectories")
    A.save_trajectories(*_artifact(spark, sf_dir), path, source_dataset="orders", condition_id="C")
    trajectories, states = A.StoredTrajectories(spark, path).load()
    told = states.join(trajectories.select("trajectory_id", "outcome"), "trajectory_id")
    return told.select("trajectory_id", "position", "node_id", rounded(F.col("distribution")["R"], "p_r"), rounded(F.col("mass_capture").cast("double"), "mass"), F.col("metadata")["priority"].alias("priority"), F.col("action.action_id").alias("action"), F.col("outcome.primary_label").alias("label"), F.col("outcome.secondary_labels")["k"].alias("other"))


QUERIES["cached_trajectories"] = cached_trajectories
ORACLES["cached_trajectories"] = f"""WITH {X.STATES}, {X.TRUTH} SELECT CAST(trajectory_id AS VARCHAR) AS trajectory_id, CAST(position AS INTEGER) AS position, status || '@' || position AS node_id, {sql_rounded('dist[3]', 'p_r')}, {sql_rounded('CAST(CAST(mass_capture AS FLOAT) AS DOUBLE)', 'mass')},
  priority, CASE WHEN position % 2 = 0 THEN priority END AS action, CAST(target AS VARCHAR) AS label, 'v' AS other FROM states JOIN truth USING (trajectory_id)"""


def nested_trajectories(spark, sf_dir):
    """src_iter's rows: a trajectory with its states in order."""
    path = placed(spark, "trajectories")
    A.save_trajectories(*_artifact(spark, sf_dir), path)
    rows = A.nested(*A.load_trajectories(spark, path))
    return rows.select("trajectory_id", "n_states", F.array_join(F.transform("states", lambda s: s["node_id"]), ",").alias("walk"))


QUERIES["nested_trajectories"] = nested_trajectories
ORACLES["nested_trajectories"] = f"WITH {X.STATES} SELECT CAST(trajectory_id AS VARCHAR) AS trajectory_id, CAST(count(*) AS INTEGER) AS n_states, string_agg(status || '@' || position, ',' ORDER BY position) AS walk FROM states GROUP BY 1"


def graph_round_trip(spark, sf_dir):
    """snk_graph, src_graph; g_builder checks the edges as they are saved."""
    path = placed(spark, "graph")
    A.save_graph(*_graph(spark, sf_dir), path, extra={"min_count": 5})
    nodes, edges = A.load_graph(spark, path)
    leaving = edges.groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("out_degree"), F.sum("frequency").alias("moves"))
    return nodes.join(leaving, "node_id", "left").select("node_id", F.col("visit_count").cast("long").alias("visit_count"), "is_terminal", F.coalesce("out_degree", F.lit(0)).alias("out_degree"), F.coalesce("moves", F.lit(0)).alias("moves"))


QUERIES["graph_round_trip"] = graph_round_trip
ORACLES["graph_round_trip"] = f"WITH {BASE} SELECT node_id, visit_count, out_degree = 0 AS is_terminal, out_degree, CAST(coalesce((SELECT sum(frequency) FROM ed WHERE source_id = node_id), 0) AS BIGINT) AS moves FROM nd JOIN dg USING (node_id)"


def visits_round_trip(spark, sf_dir):
    """snk_visits, src_visits, bld_vec, snk_vec, src_vec: visits by timestep
    and the manifest's numbers."""
    path = placed(spark, "visits")
    v = X.visits(spark, sf_dir).select("visit_seq", F.col("visit_seq").cast("string").alias("trajectory_id"), "timestep", F.concat(F.lit("n"), F.col("timestep").cast("string")).alias("node_id"), "embedding")
    A.save_visits(v, path)
    manifest = spark.createDataFrame([(k, n) for k, n in A.vector_manifest(spark, path).items()], "timestep int, listed long")
    rows = A.load_visits(spark, path).groupBy("timestep").agg(F.count("*").alias("n"), F.min("visit_seq").alias("first"), F.max(F.size("embedding")).alias("dimension"))
    return rows.withColumn("timestep", F.col("timestep").cast("int")).join(manifest, "timestep")


QUERIES["visits_round_trip"] = visits_round_trip
ORACLES["visits_round_trip"] = "SELECT label AS timestep, count(*) AS n, min(vec_id) AS first, 64 AS dimension, count(*) AS listed FROM embeddings GROUP BY 1"


def scores_round_trip(spark, sf_dir):
    """snk_scores, src_scores, src_weights."""
    path, weights = placed(spark, "scores"), {"entropy_plateau": 0.5, "composite": 0.5}
    found = trajectory.scores(X.states(spark, sf_dir)).select("trajectory_id", "entropy_plateau", F.lit(0.0).alias("voi_flatness"), F.lit(0.0).alias("distance_from_trajectory"), F.col("mean_entropy").alias("composite"))
    A.save_scores(found, path, weights, {"condition_c": 1})
    back = A.load_weights(spark, path)
    return A.load_table(spark, path).select("trajectory_id", rounded(sum((F.col(c) * w for c, w in back.items()), F.lit(0.0)), "weighted"))


QUERIES["scores_round_trip"] = scores_round_trip
ORACLES["scores_round_trip"] = f"WITH {PER_TRAJECTORY} SELECT trajectory_id, {sql_rounded('0.5 * entropy_plateau + 0.5 * mean_entropy', 'weighted')} FROM tr"


def assembly_round_trip(spark, sf_dir):
    """snk_ai, src_ai."""
    path = placed(spark, "assembly")
    A.save_assembly(assembly(spark, sf_dir).withColumnRenamed("assembly_index_unweighted", "assembly_index"), path)
    return A.load_table(spark, path).groupBy("assembly_index").agg(F.count("*").alias("n"))


QUERIES["assembly_round_trip"] = assembly_round_trip
ORACLES["assembly_round_trip"] = f"""WITH RECURSIVE {BASE.lstrip()}, lv AS (SELECT node_id, 0 AS steps FROM dg WHERE in_degree = 0 UNION SELECT target_id, steps + 1 FROM lv JOIN ed ON source_id = lv.node_id WHERE steps < 20)
SELECT steps AS assembly_index, count(*) AS n FROM nd LEFT JOIN (SELECT node_id, min(steps) AS steps FROM lv GROUP BY 1) USING (node_id) GROUP BY 1"""


def resumed_log(spark, sf_dir):
    """snk_jsonl_append, checkpoint, join_anti_resume: half of the work is in
    the log already, the rest is done in three pieces and logged. Then one
    piece is written again and the whole run started again, as after a driver
    that was lost, which adds nothing."""
    work = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"))
    path = placed(spark, "log")
    A.append_json(work.where("question_id % 2 = 0").withColumn("turn", F.lit(1)), path)
    run = lambda turn: A.resumed(spark, work, path, lambda todo: todo.withColumn("turn", F.lit(turn)), parts=3, run="nightly")
    run(2)
    A.append_json(work.withColumn("turn", F.lit(3)), path, "nightly-3-1")
    return run(4).select("question_id", F.col("turn").cast("int").alias("turn"))


QUERIES["resumed_log"] = resumed_log
ORACLES["resumed_log"] = "SELECT item_id AS question_id, CAST(item_id % 2 + 1 AS INTEGER) AS turn FROM benchmark"


def results_round_trip(spark, sf_dir):
    """snk_csv/json: result tables as one CSV file each, and their summary."""
    found = trajectory.scores(X.states(spark, sf_dir)).select("trajectory_id", F.round("mean_entropy", 6).alias("mean_entropy"))
    areas = evaluate.deferral_auc(evaluate.long_scores(found, X.truth(spark, sf_dir), ["mean_entropy"])).select("score_column", "n_pos", "n_neg")
    path = placed(spark, "results")
    A.save_results({"scores": found, "areas": areas}, {"rows": 1}, path)
    return A.load_results(spark, path, "areas").select("score_column", F.col("n_pos").cast("long").alias("n_pos"), F.col("n_neg").cast("long").alias("n_neg")).withColumn("scores", F.lit(A.load_results(spark, path, "scores").count()))


QUERIES["results_round_trip"] = results_round_trip
ORACLES["results_round_trip"] = f"WITH {X.STATES}, {X.TRUTH} SELECT 'mean_entropy' AS score_column, count(*) FILTER (target = 1) AS n_pos, count(*) FILTER (target = 0) AS n_neg, CAST(count(*) AS INTEGER) AS scores FROM truth"


def _medqa(spark, sf_dir):
    p = X.table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("row_index"), F.col("p_name").alias("question"), F.create_map(F.lit("A"), F.col("p_type"), F.lit("B"), F.col("p_brand")).alias("options"), F.when(F.col("p_size") % 2 == 0, "A").otherwise("B").alias("answer_idx"), F.col("p_brand").alias("meta_info"))
    return Q.multiple_choice(rows, "test")


QUERIES["src_medqa"] = lambda s, d: _medqa(s, d).select("question_id", "question", F.col("choices")["A"].alias("a"), "answer_letter", "usmle_step")
ORACLES["src_medqa"] = "SELECT 'medqa-test-' || p_partkey AS question_id, p_name AS question, p_type AS a, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS answer_letter, p_brand AS usmle_step FROM part"


QUERIES["explore_questions"] = lambda s, d: Q.profile(_medqa(s, d)).select("section", "key", rounded("value"))
ORACLES["explore_questions"] = f"""WITH q AS (SELECT length(p_name) AS n, p_brand AS meta, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS answer FROM part)
SELECT section, key, {sql_rounded('value', 'value')} FROM (
  SELECT 'size' AS section, 'questions' AS key, count(*)::DOUBLE AS value FROM q UNION ALL SELECT 'length', 'min', min(n) FROM q UNION ALL SELECT 'length', 'max', max(n) FROM q UNION ALL SELECT 'length', 'mean', avg(n) FROM q
  UNION ALL SELECT 'length', 'median', quantile_cont(n, 0.5) FROM q UNION ALL SELECT 'mismatch', 'answer', 0 UNION ALL SELECT 'mismatch', 'blank choice', 0
  UNION ALL SELECT 'choices', '2', count(*) FROM q UNION ALL SELECT 'meta', meta, count(*) FROM q GROUP BY meta UNION ALL SELECT 'answer', answer, count(*) FROM q GROUP BY answer)"""


def with_outcome(spark, sf_dir):
    """answer_key and with_outcome: gold labels put beside trajectories, which
    are all the parts that were ordered; some have no question."""
    q = _medqa(spark, sf_dir)
    t = X.table(spark, sf_dir, "lineitem").select(F.concat(F.lit("medqa-test-"), (F.col("l_partkey") + F.when(F.col("l_linenumber") > 5, 1_000_000).otherwise(0)).cast("string")).alias("trajectory_id")).distinct()
    return Q.with_outcome(t, Q.answer_key(q)).select("trajectory_id", "primary_label", "confidence", F.col("secondary_labels")["question_id"].alias("of"))


QUERIES["with_outcome"] = with_outcome
QUERIES["answer_key"] = lambda s, d: Q.answer_key(_medqa(s, d)).groupBy("primary_label").agg(F.count("*").alias("n"), F.sum("confidence").alias("sure"))
_GOLD = "SELECT 'medqa-test-' || p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'A' ELSE 'B' END AS gold FROM part"
ORACLES["with_outcome"] = f"SELECT 'medqa-test-' || k AS trajectory_id, gold AS primary_label, CASE WHEN gold IS NOT NULL THEN 1.0::DOUBLE END AS confidence, id AS of FROM (SELECT DISTINCT l_partkey + CASE WHEN l_linenumber > 5 THEN 1000000 ELSE 0 END AS k FROM lineitem) LEFT JOIN ({_GOLD}) ON id = 'medqa-test-' || k"
ORACLES["answer_key"] = f"SELECT gold AS primary_label, count(*) AS n, count(*)::DOUBLE AS sure FROM ({_GOLD}) GROUP BY 1"


def _raises(check) -> bool:
    try:
        check()
    except (guards.GuardError, A.ArtifactError, evaluate.EvaluationError, KeyError, ValueError):
        return True
    return False


def guard_verdicts(spark, sf_dir):
    """Every guard on the tables, and on a broken version of them: whether it
    raises."""
    states = X.states(spark, sf_dir).withColumn("metadata", F.create_map(F.lit("model"), F.lit("m"))).withColumn("embedding", F.when(F.col("mass_capture").isNotNull(), F.array(F.lit(1.0))))
    # Read by several guards each.
    states = cut_lineage(states.select("trajectory_id", "position", "mass_capture", "metadata", "embedding"), "states")
    full = states.where("mass_capture is not null")
    nodes, edges = _graph(spark, sf_dir)
    nodes, edges = cut_lineage(nodes, "graph-nodes"), cut_lineage(edges, "graph-edges")
    t, s = (cut_lineage(x, "artifact") for x in _artifact(spark, sf_dir))
    mixed = states.withColumn("metadata", F.create_map(F.lit("model"), F.when(F.col("position") == 0, "m").otherwise("n")))
    truth = cut_lineage(X.truth(spark, sf_dir), "truth")
    checks = {
        "embedding_uniform": (lambda: guards.embeddings_uniform(full), lambda: guards.embeddings_uniform(full.withColumn("embedding", F.when(F.col("position") > 0, F.col("embedding"))))),
        "metadata_consistent": (lambda: guards.metadata_consistent(s.withColumn("metadata_json", F.lit("{}"))), lambda: guards.metadata_consistent(s)),
        "provenance": (lambda: guards.one_provenance(states), lambda: guards.one_provenance(mixed)),
        "trajectory": (lambda: guards.trajectories_whole(states), lambda: guards.trajectories_whole(states.where("position > 0"))),
        "builder": (lambda: guards.edges_valid(nodes, edges), lambda: guards.edges_valid(nodes.where("node_id not like 'view%'"), edges)),
        "weights": (lambda: guards.weights_valid({"a": 0.5, "b": 0.5}), lambda: guards.weights_valid({"a": 1.5, "b": -0.5})),
        "recovery": (lambda: graph.RecoveryConfig(), lambda: graph.RecoveryConfig(high=20.0, low=30.0)),
        "key_equality": (lambda: guards.same_keys({"a": 1}, {"a": 2}), lambda: guards.same_keys({"a": 1}, {"b": 1})),
        "both_classes": (lambda: evaluate.require_both_classes(truth), lambda: evaluate.require_both_classes(truth.where("target = 1"))),
        "columns": (lambda: A.require_columns(s, ("node_id",)), lambda: A.require_columns(s, ("nothing",))),
        "json": (lambda: A.require_json(s, ["metadata_json"]), lambda: A.require_json(s.withColumn("metadata_json", F.lit("{")), ["metadata_json"])),
        "cached": (lambda: A.save_trajectories(t, s, placed(spark, "t")), lambda: A.save_trajectories(t, s.where("position <> 1"), placed(spark, "t"))),
        "class": (lambda: graph.edges_by_class(edges, 0), lambda: graph.edges_by_class(edges, 9)),
        "missing": (lambda: A.write_file(spark, place := placed(spark, "file"), "x") or A.read_file(spark, place), lambda: A.read_file(spark, placed(spark, "file"))),
    }
    return spark.createDataFrame([(name, _raises(good), _raises(bad)) for name, (good, bad) in checks.items()], "name string, raises boolean, broken_raises boolean")


QUERIES["guard_verdicts"] = guard_verdicts
ORACLES["guard_verdicts"] = """WITH c(name) AS (VALUES ('embedding_uniform'), ('metadata_consistent'), ('provenance'), ('trajectory'), ('builder'), ('weights'), ('recovery'), ('key_equality'), ('both_classes'), ('columns'), ('json'), ('cached'), ('class'), ('missing'))
SELECT name, false AS raises, true AS broken_raises FROM c"""


def metadata_conflicts(spark, sf_dir):
    """The guard's own query: nodes with more than one metadata value."""
    e = X.table(spark, sf_dir, "events").select(F.concat_ws("@", "event_type", F.pmod("user_id", F.lit(5)).cast("string")).alias("node_id"), "props")
    return guards.metadata_conflicts(e, "props")


QUERIES["g_metadata_consistent"] = metadata_conflicts
ORACLES["g_metadata_consistent"] = "SELECT event_type || '@' || (user_id % 5) AS node_id, count(DISTINCT coalesce(props, 'null')) AS n FROM events GROUP BY 1 HAVING count(DISTINCT coalesce(props, 'null')) > 1"


def missing_columns(spark, sf_dir):
    """What the check says of each table."""
    required = {"documents": ("doc_id", "text", "embedding"), "labels": ("doc_id", "quality"), "embeddings": ("vec_id", "text"), "events": ("ts", "event_id")}
    rows = []
    for name, columns in required.items():
        try:
            A.require_columns(X.table(spark, sf_dir, name), columns)
        except A.ColumnsMissing as error:
            rows.append((name, str(error)))
    return spark.createDataFrame(rows, "table_name string, missing string")


QUERIES["missing_columns"] = missing_columns
ORACLES["missing_columns"] = "SELECT t AS table_name, string_agg(c, ', ') AS missing FROM (VALUES ('documents', 'doc_id'), ('documents', 'text'), ('documents', 'embedding'), ('labels', 'doc_id'), ('labels', 'quality'), ('embeddings', 'vec_id'), ('embeddings', 'text'), ('events', 'ts'), ('events', 'event_id')) r(t, c) WHERE (t, c) NOT IN (SELECT (table_name, column_name) FROM information_schema.columns) GROUP BY 1"
