"""Operators on toy tables with hand-derived values."""

import math

import pytest
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions import uncertainty as U
from brindle.operators import conditions, evaluate, graph, guards, knn, measure, ordered, signatures, stats, trajectory, vector_index
from brindle.sources import artifacts, store
from brindle.streaming import scoring


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def dist(**p):
    return F.create_map(*[F.lit(x) for kv in p.items() for x in kv])


def logs(*p):
    return F.array(*[F.lit(math.log(x)) for x in p])


def test_entropies(spark):
    assert value(spark, U.entropy_bits(dist(A=0.5, B=0.5, C=0.0))) == 1.0
    assert value(spark, U.entropy_nats(dist(A=0.5, B=0.5))) == pytest.approx(math.log(2))
    assert value(spark, U.entropy_full(logs(0.5, 0.25))) == pytest.approx(1.5 * math.log(2))
    assert value(spark, U.varentropy(logs(0.2, 0.2))) == pytest.approx(0)
    assert value(spark, U.entropy_full_renormalized(logs(0.2, 0.2))) == pytest.approx(math.log(2))
    assert value(spark, U.entropy_full(F.array().cast("array<double>"))) == 0


def test_top_k(spark):
    p = logs(0.1, 0.6, 0.3)
    assert value(spark, U.p_max(p)) == pytest.approx(0.6)
    assert value(spark, U.gap_top2(p)) == pytest.approx(0.3)
    assert value(spark, U.gap_top1_top_k(p, 3)) == pytest.approx(0.5)
    assert value(spark, U.gap_top1_top_k(p, 4)) == 0
    assert value(spark, U.top_k_mass(p, 10)) == pytest.approx(1.0)
    assert value(spark, U.p_max(F.array().cast("array<double>"))) == 0


def test_answers(spark):
    assert value(spark, U.one_hot(F.lit("B"), ["A", "B"])) == {"A": 0.0, "B": 1.0}
    assert value(spark, U.one_hot(F.lit(None).cast("string"), ["A", "B"])) == {"A": 0.5, "B": 0.5}
    assert value(spark, U.confidence_weighted(F.lit("A"), F.lit(0.7), ["A", "B", "C"])) == pytest.approx({"A": 0.7, "B": 0.15, "C": 0.15})
    assert value(spark, U.argmax(dist(B=0.4, A=0.4, C=0.2))) == "A"
    assert value(spark, U.js_divergence(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)))) == pytest.approx(1.0)
    assert value(spark, U.alias_mass(F.create_map(F.lit(" A"), F.lit(0.25), F.lit("A"), F.lit(0.5)), ["A", "B"])) == {"A": 0.75, "B": 0.0}
    lo, hi = U.wilson(F.lit(5), F.lit(10))
    assert value(spark, lo) == pytest.approx(0.2366, abs=1e-4) and value(spark, hi) == pytest.approx(0.7634, abs=1e-4)
    assert math.isnan(value(spark, U.wilson(F.lit(0), F.lit(0))[0]))
    with pytest.raises(Exception, match="outside"):
        value(spark, U.clipped(F.lit(1.1)))


def test_decompose(spark):
    d = value(spark, T.decompose(F.lit("reasoning step 1: a\nReasoning Step 2:  b \nx\n**Final answer:** C. Wait, final answer: (d)")))
    assert (d.steps, d.answer, d.n_raw, d.used_fallback) == (["a", "b"], "D", 2, False) and "few steps" in d.warnings
    d = value(spark, T.decompose(F.lit("one\n \n two\n\n\nthree")))
    assert d.steps == ["one", "two", "three"] and d.used_fallback and d.answer is None
    many = "\n".join(f"Reasoning step {i}: s{i}" for i in range(1, 13))
    assert value(spark, T.decompose(F.lit(many))).steps == [f"s{i}" for i in (1, 2, 3, 5, 6, 7, 8, 10, 11, 12)]
    with pytest.raises(Exception, match="too few"):
        value(spark, T.decompose(F.lit("nothing"), strict=True))


def test_configurations_are_checked(spark):
    nodes, edges = spark.createDataFrame([("a",)], "node_id string"), edge_table(spark, [("a", "x", "b", 0)])
    for bad in (lambda: T.decompose(F.lit("x"), max_steps=2), lambda: T.decompose(F.lit("x"), min_steps=0), lambda: graph.assembly_indices(nodes, edges, {0: -1.0}), lambda: graph.assembly_indices(nodes, edges, {9: 1.0}), lambda: graph.assembly_indices(nodes, edges, max_rounds=0)):
        with pytest.raises(ValueError):
            bad()


def test_many_paths_do_not_overflow(spark):
    rows = [(f"n{k}", f"x{j}", f"n{k + 1}", 0) for k in range(14) for j in range(1000)]
    got = {r.node_id: r.n_paths for r in graph.assembly_indices(spark.createDataFrame([(f"n{k}",) for k in range(15)], "node_id string"), edge_table(spark, rows)).collect()}
    assert got["n12"] == 1000**12 and got["n0"] == 1 and got["n13"] is None and got["n14"] is None


def test_lookups(spark):
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "node_id string"), edge_table(spark, [("a", "x", "b", 0), ("b", "x", "a", 3)])
    wanted = spark.createDataFrame([("a",), ("z",)], "node_id string")
    assert {r.node_id: r.known for r in graph.has_node(nodes, wanted).collect()} == {"a": True, "z": False}
    assert graph.out_edges(edges, wanted).first().target_id == "b" and graph.in_edges(edges, wanted).first().source_id == "b"
    assert graph.edges_by_class(edges, 3).count() == 1 and graph.get_nodes(nodes, wanted.where("node_id = 'a'")).count() == 1
    with pytest.raises(KeyError):
        graph.get_nodes(nodes, wanted)


def test_fill_is_one_pass(spark):
    assert value(spark, T.fill("{a}-{b}-{c}", a=F.lit("{b}"), b=F.lit("{a}"))) == "{b}-{a}-{c}"


def test_parsers(spark):
    assert value(spark, T.parse_confidence(F.lit("x\n Confidence: 0.8 \nConfidence: 0.1"))) == 0.8
    assert value(spark, T.parse_confidence(F.lit("Confidence: 1.5"))) is None
    letters = F.array(*map(F.lit, "ABCD"))
    assert value(spark, T.extract_letter(F.lit("the answer: (b) or C"), letters)) == "B"
    assert value(spark, T.extract_letter(F.lit("maybe C"), letters)) == "C"
    assert value(spark, T.extract_letter(F.lit("E"), letters)) is None
    assert value(spark, T.prompt_version(F.lit("\n# version: 3\nbody"))) == 3
    assert value(spark, T.prompt_body(F.lit("# version: 3\nbody"))) == "body"
    assert value(spark, T.common_prefix(F.array(F.array(*map(F.lit, (1, 2, 3))), F.array(*map(F.lit, (1, 2, 4)))))) == 2


def scored(spark, rows):
    return spark.createDataFrame([("s", float(s) if s is not None else None, y) for s, y in rows], "score_column string, score double, target int")


def test_areas(spark):
    perfect = scored(spark, [(0.1 * i, int(i > 4)) for i in range(10)])
    r = evaluate.deferral_auc(perfect).first()
    assert (r.roc_auc, r.pr_auc, r.direction) == (1.0, 1.0, "greater")
    flipped = evaluate.deferral_auc(perfect.withColumn("score", -F.col("score"))).first()
    assert (flipped.roc_auc, flipped.roc_auc_sign_aware, flipped.direction) == (0.0, 1.0, "less")
    flat = evaluate.deferral_auc(scored(spark, [(0.5, i % 2) for i in range(10)])).first()
    assert (flat.roc_auc, flat.direction, flat.pr_auc) == (0.5, "greater", 0.5)
    dropped = evaluate.deferral_auc(scored(spark, [(None, 1), (float("nan"), 0), (1, 1), (0, 0)])).first()
    assert (dropped.n_dropped, dropped.roc_auc) == (2, 1.0)
    none = evaluate.deferral_auc(scored(spark, [(None, 1), (None, 0)])).first()
    assert math.isnan(none.roc_auc) and none.direction is None


def test_roc_points(spark):
    df = scored(spark, [(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)])
    got = [(r.threshold, r.fpr, r.tpr) for r in evaluate.roc_table(df).orderBy("idx").collect()]
    assert got == [(math.inf, 0.0, 0.0), (0.8, 0.0, 0.5), (0.4, 0.5, 0.5), (0.35, 0.5, 1.0), (0.1, 1.0, 1.0)]
    assert evaluate.threshold_at_fpr(df, 0.0).first().threshold == 0.8
    assert evaluate.threshold_at_sensitivity(df, 0.9).first().threshold == 0.35
    with pytest.raises(evaluate.EvaluationError):
        evaluate.threshold_at_fpr(df, 2)
    with pytest.raises(evaluate.EvaluationError):
        evaluate.require_both_classes(df.where("target = 1"))


def test_curve_and_calibration(spark):
    flat = scored(spark, [(0.5, i % 2) for i in range(10)])
    first = evaluate.deferral_curve(flat).orderBy("deferral_fraction").first()
    assert first.deferred_count == 10 and math.isnan(first.residual_error_rate)
    c = evaluate.calibration_metrics(flat).first()
    assert (c.ece, c.mce, c.brier_score) == (0.0, 0.0, 0.25)
    assert evaluate.calibration_metrics(scored(spark, [(0.0, 0), (1.0, 1)]), binning="equal_width").first().ece == 0


@pytest.mark.parametrize("cuts", [None, 1, 5])
def test_ordered_sums(spark, cuts):
    values = [5, 1, 3, 3, 9, 7, 7, 7, 2]
    df = spark.createDataFrame([(v,) for v in values], "v int").withColumn("k", F.lit(0))
    q = ordered.quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.5, "c": 0.9, "d": 1.0}, cuts).first()
    assert (q.a, q.b, q.c, q.d) == (1, 5, pytest.approx(7.4), 9)
    r = {x.v: x.r for x in ordered.rank_percentile(df, ["k"], "v", "r", cuts).collect()}
    assert r[3] == pytest.approx(3.5 / 9) and r[7] == pytest.approx(7 / 9) and r[9] == 1
    assert ordered.rank_percentile(df.where("v = 9"), ["k"], "v", "r").first().r == 0.5


def steps(spark, rows):
    return spark.createDataFrame(rows, "trajectory_id int, position int, node_id string, action_id string, outcome string")


def test_one_bit(spark):
    rows = []
    for t in range(20):
        end, label = ("B", "dx_a") if t < 10 else ("C", "dx_b")
        rows += [(t, 0, "A", "x", label), (t, 1, end, None, label)]
    nodes, edges = graph.recover(steps(spark, rows))
    got = {r.target_id: (r.frequency, r.voi, r.consensus_rate) for r in edges.collect()}
    assert got == {"B": (10, pytest.approx(1.0), 1.0), "C": (10, pytest.approx(1.0), 1.0)}
    assert {r.node_id: r.is_terminal for r in nodes.collect()} == {"A": False, "B": True, "C": True}


def edge_table(spark, rows):
    return spark.createDataFrame(rows, "source_id string, action_id string, target_id string, classification int").withColumn("frequency", F.lit(1)).withColumn("voi", F.lit(0.0))


def test_paths(spark):
    diamond = edge_table(spark, [("a", "x", "b", 0), ("a", "x", "c", 3), ("b", "x", "d", 0), ("c", "x", "d", 0), ("b", "y", "d", 3), ("i", "x", "i", 0)])
    nodes = spark.createDataFrame([(n,) for n in "abcdi"], "node_id string")
    got = {r.node_id: tuple(r)[1:] for r in graph.assembly_indices(nodes, diamond).collect()}
    assert got == {"a": (0, 0.0, 1), "b": (1, 1.0, 1), "c": (1, 5.0, 1), "d": (2, 2.0, 3), "i": (None, None, 0)}
    with pytest.raises(ValueError):
        graph.assembly_indices(nodes.where("node_id = 'i'"), diamond.where("source_id = 'i'"))


def test_voi_flatness(spark):
    e = spark.createDataFrame([("a", "x", "b", 0.5), ("b", "x", "c", -0.3)], "source_id string, action_id string, target_id string, voi double")
    walk = steps(spark, [(1, 0, "a", "x", None), (1, 1, "b", "x", None), (1, 2, "c", None, None), (2, 0, "a", "z", None), (2, 1, "c", None, None), (3, 0, "a", None, None)])
    assert {r.trajectory_id: r.voi_flatness for r in graph.voi_flatness(walk, e).collect()} == {1: pytest.approx(0.4), 2: 0.5, 3: 0.0}


def test_neighbours(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 0, [0.0, 1.0]), (3, 0, [0.6, 0.8]), (4, 1, [1.0, 0.0])], "visit_seq long, timestep int, embedding array<float>")
    got = [(r.visit_seq, round(r.similarity, 3)) for r in knn.nearest(v.where("visit_seq = 1"), v, 2, exclude_self=True).orderBy("rank").collect()]
    assert got == [(3, 0.6), (2, 0.0)]
    with pytest.raises(Exception, match="unit length"):
        knn.nearest(v, v.withColumn("embedding", F.array(F.lit(2.0), F.lit(0.0)).cast("array<float>"))).collect()


def test_neighbours_by_blocks_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[200:220] = x[0]  # ties
    rows = [(i, int(i % 7 == 0), x[i].tolist()) for i in range(300)]
    v = spark.createDataFrame(rows, "visit_seq long, timestep int, embedding array<float>")
    y = np.array([np.float32(r[2]) for r in rows], float)
    for exclude in (False, True):
        got = {(r.query_seq, r["rank"]): r.visit_seq for r in knn.nearest(v, v, 4, exclude, leaf=40).collect()}
        for i in range(0, 300, 17):
            near = sorted((-round(float(y[i] @ y[j]), 9), j) for j in range(300) if rows[i][1] == rows[j][1] and not (exclude and i == j))[:4]
            assert [got[i, k + 1] for k in range(4)] == [j for _, j in near]
    with pytest.raises(Exception, match="differ in length"):
        knn.nearest(v, v.withColumn("embedding", F.when(F.col("visit_seq") > 0, F.col("embedding")))).collect()


def test_index_leaves_out_clusters_and_nothing_else(spark, tmp_path, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    x = np.concatenate([centres[rng.integers(0, 12, 500)] + 0.05 * rng.normal(size=(500, 8)), np.repeat(centres[:1], 60, 0)])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")
    v = spark.createDataFrame([(i, i % 2, x[i].tolist()) for i in range(560)], "visit_seq long, timestep int, embedding array<float>")
    monkeypatch.setattr(vector_index, "FAN", 4)
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    index = vector_index.build(v, leaf=30)
    sizes = {(r.timestep, r.node): r["count"] for r in index.members.groupBy("timestep", "node").count().collect()}
    assert sum(sizes.values()) == 560 and index.depth > 1 and len(sizes) > 12
    for r in index.tree.collect():
        assert r.n == sum(n for (t, node), n in sizes.items() if t == r.timestep and (node + ".").startswith(r.node + "."))
    artifacts.save_index(index, f"file://{tmp_path}/index")
    index = artifacts.load_index(spark, f"file://{tmp_path}/index")
    y = x.astype(float)
    for exclude, k in ((False, 3), (True, 5), (False, 100)):
        got = {(r.query_seq, r["rank"]): r.visit_seq for r in vector_index.search(index, v, k, exclude).collect()}
        for i in range(0, 560, 29):
            near = sorted((-round(float(y[i] @ y[j]), 9), j) for j in range(i % 2, 560, 2) if not (exclude and i == j))[:k]
            assert [got.get((i, n + 1)) for n in range(k)] == [j for _, j in near]
    # Of all pairs of a query and a leaf of its timestep few are looked at.
    _, further = vector_index.reached(index, v, 3, False)
    pairs = sum(280 for _ in sizes)
    assert 560 + further.count() < pairs / 3
    other = v.where("visit_seq < 5").withColumn("timestep", F.lit(9))
    assert vector_index.search(index, other, 3).count() == 0 and vector_index.search(index, v.limit(0), 3).count() == 0
    assert vector_index.search(vector_index.build(v.limit(0)), v, 3).count() == 0


@pytest.mark.parametrize("copy", [0, 1000])
def test_index_that_cannot_prune_sends_queries_to_whole_nodes(spark, monkeypatch, copy):
    import numpy as np

    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 32))
    x[:300, 2:] *= 0.01  # half can be pruned, half can't
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")
    v = spark.createDataFrame([(i, i // 300, x[i].tolist()) for i in range(600)], "visit_seq long, timestep int, embedding array<float>")
    monkeypatch.setattr(vector_index, "MET", 200)
    monkeypatch.setattr(vector_index, "COPY", copy, raising=False)
    index = vector_index.build(v, leaf=8)
    _, further = vector_index.reached(index, v, 3, False)
    assert further.where("timestep = 1").count() <= 300 * (2 if copy else 300)
    got = {(r.query_seq, r["rank"]): r.visit_seq for r in vector_index.search(index, v, 3).collect()}
    near = np.round(x.astype(float) @ x.astype(float).T, 9)
    for i in range(600):
        best = sorted((-near[i, j], j) for j in range(i // 300 * 300, i // 300 * 300 + 300))[:3]
        assert [got[i, r + 1] for r in range(3)] == [j for _, j in best]
    assert len(got) == 1800


def test_lists_of_pairs_are_evaluated_once(spark):
    rows = spark.createDataFrame([({"A": 3.0, "B": 1.0},), ({},), (None,)], "zz map<string,double>")
    p = U.projected(F.col("zz"), ["A", "B"])
    spread = U.mean_pairwise(F.array(p, F.array(F.lit(0.5), F.lit(0.5)), F.array(F.lit(1.0), F.lit(0.0))), U.js_divergence)
    got = [r.v for r in rows.select(spread.alias("v")).collect()]
    h = lambda x: -sum(y * math.log2(y) for y in (x, 1 - x) if y)
    js = lambda a, b: h((a + b) / 2) - (h(a) + h(b)) / 2
    assert got == [pytest.approx((js(a, 0.5) + js(a, 1) + js(0.5, 1)) / 3) for a in (0.75, 0.5, 0.5)]
    # As often as in one list, not for each pair and use.
    plan = rows.select(spread.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    once = rows.select(F.array(p, p).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("element_at(zz") <= once.count("element_at(zz")


def test_equal_lists_are_perturbed_once(monkeypatch):
    import numpy as np
    import pandas as pd

    drawn, draw = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda s: drawn.append(s) or draw(s))
    lists = [[0.0, 1.0, 0.0], [0.5, 0.5], [0.2, 0.3, 0.5]] * 40
    got = stats.noisy_spread(pd.Series(lists), 0.5, 16, 42)
    assert len(drawn) == 3 and len(got) == 120 and got.nunique() == 3 and (got[:3].tolist() * 40) == got.tolist()


def test_trajectory_defaults(spark):
    s = spark.createDataFrame([(1, 0, None, None), (2, 0, {"A": 0.5, "B": 0.5}, 0.9), (2, 1, None, None), (2, 2, {"A": 1.0, "B": 0.0}, 0.8)], "trajectory_id int, position int, distribution map<string,double>, mass_capture double")
    got = {r.trajectory_id: r for r in trajectory.scores(s).collect()}
    assert (got[1].mean_entropy, got[1].entropy_plateau, got[1].mass_capture_min) == (0, 0, 1)
    assert (got[2].mean_entropy, got[2].entropy_plateau, got[2].entropy_slope_ts) == (0.5, -1.0, -0.5)
    with pytest.raises(ValueError):
        trajectory.per_state("x", F.col("h"), "mode", 0.0)


def test_statistics(spark):
    df = spark.createDataFrame([(i, float(i), float(i * i), int(i > 4)) for i in range(10)], "id int, a double, b double, target int")
    assert stats.spearman(df, "id", "a", "b").first().rho == pytest.approx(1.0)
    assert stats.ks_two_sample(df, "a").first().d == 1.0
    assert stats.mann_whitney(df, "a").first().u == 25
    assert stats.cohen_d(df, "a").first().d == pytest.approx(5 / math.sqrt(2.5))


QUESTION = [("q1", "why {choices}?", {"A": "x", "B": "y"})]
REPLY = "Reasoning step 1: a\nReasoning step 2: b\nReasoning step 3: c\nFinal answer: A"


@pytest.mark.parametrize("n1, n0", [(3, 4), (5, 2), (1, 6)])
def test_small_mann_whitney_is_exact(spark, n1, n0):
    from itertools import combinations

    places = [sum(p > q for p in c for q in set(range(n1 + n0)) - set(c)) for c in combinations(range(n1 + n0), n1)]
    for u in set(places):
        far = max(u, n1 * n0 - u)
        assert stats.mann_whitney_exact(u, n1, n0) == pytest.approx(min(1, 2 * sum(x >= far for x in places) / len(places)))
    df = spark.createDataFrame([(float(k), int(k < n1)) for k in range(n1 + n0)], "v double, target int")
    r = stats.mann_whitney(df, "v").first()
    assert r.u == 0 and r.p_exact == stats.mann_whitney_exact(0, n1, n0) != r.p
    tied = stats.mann_whitney(df.withColumn("v", F.lit(1.0)), "v").first()
    assert tied.p_exact == tied.p or math.isnan(tied.p_exact)


def test_logistic_folds_equal_newton(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 2))
    y = (x[:, 0] + rng.normal(size=90) > 0).astype(int)
    df = spark.createDataFrame([(i, float(x[i, 0]), float(x[i, 1]), int(y[i]), i % 3) for i in range(90)], "id int, a double, b double, target int, fold int")
    got = {r.id: r.oof for r in stats.cv_logistic(df, ["a", "b"], folds=3).collect()}
    for k in range(3):
        train = np.arange(90) % 3 != k
        design, w = np.c_[x, np.ones(90)], np.zeros(3)
        for _ in range(50):  # half the squared weights, but not the intercept's, and the sum of losses
            p = 1 / (1 + np.exp(-design[train] @ w))
            ridge = np.diag([1.0, 1.0, 0.0])
            w -= np.linalg.solve((design[train].T * (p * (1 - p))) @ design[train] + ridge, design[train].T @ (p - y[train]) + ridge @ w)
        for i in np.flatnonzero(~train):
            assert got[int(i)] == pytest.approx(1 / (1 + math.exp(-design[i] @ w)), abs=1e-5)
    areas = {r.model: r.roc_auc for r in stats.cv_areas(df, {"M0": ["a"], "M1": ["a", "b"]}, folds=3).collect()}
    p = np.array([got[i] for i in range(90)])
    assert areas["M1"] == pytest.approx(np.mean([(s > t) + 0.5 * (s == t) for s in p[y == 1] for t in p[y == 0]]), abs=1e-3) and set(areas) == {"M0", "M1"}


def test_noise_disagreement(spark):
    df = spark.createDataFrame([(1, [0.2, 0.3, 0.5]), (2, [0.2, 0.3, 0.5]), (3, [1.0, 0.0, 0.0])], "id int, p array<double>")
    still = stats.perturb_disagree(df, "p", 0.0).collect()
    assert all(abs(r.perturb_disagree) < 1e-12 for r in still)
    small, large = ({r.id: r.perturb_disagree for r in stats.perturb_disagree(df, "p", s).collect()} for s in (0.1, 2.0))
    assert small[1] == small[2] and 0 < small[1] < large[1] <= 1 and small[3] < 1e-6


def asked(spark, n=1):
    return spark.createDataFrame([(f"q{k}", q, c) for k in range(1, n + 1) for _, q, c in QUESTION], "question_id string, question string, choices map<string,string>")


class Logged(measure.ScriptedModel):
    """Writes each call's prompt to a folder that all tasks see."""

    folder = ""

    def _log(self, kind, prompt):
        import uuid
        from pathlib import Path

        Path(self.folder, f"{kind}-{uuid.uuid4().hex}").write_text(prompt)

    def generate(self, prompt, **k):
        self._log("generate", prompt)
        return self.response

    def top_logprobs(self, prompt, k):
        self._log("measure", prompt)
        return super().top_logprobs(prompt, k)


def calls(folder, kind):
    return [p.read_text() for p in folder.glob(f"{kind}-*")]


def test_each_prompt_is_asked_once(spark, tmp_path):
    def factory():
        model = Logged(REPLY, "AB")
        model.folder = str(tmp_path)
        return model

    q = asked(spark, 10)
    a = conditions.condition_a(q, factory)
    assert a.count() == 10 and a.where("success and n_calls = 1").count() == 10 and len(calls(tmp_path, "generate")) == 10
    results, states = conditions.condition_c(q, factory, ["A", "B"])
    assert results.count() == 10 and states.count() == 40 and states.where("error is null" if "error" in states.columns else "true").count() == 40
    assert len(calls(tmp_path, "generate")) == 20 and len(calls(tmp_path, "measure")) == 40
    assert "why {choices}?" in calls(tmp_path, "generate")[0]


def test_conditions(spark):
    q = asked(spark)
    a = conditions.condition_a(q, measure.ScriptedModel).first()
    assert (a.predicted_answer, a.deferral_signal, a.success) == ("A", 0.5, True)
    results, states = conditions.condition_c(q, lambda: measure.ScriptedModel(space="AB"), ["A", "B"])
    rows = states.orderBy("position").collect()
    assert [r.step_text for r in rows] == [None, "a", "b", "c"] and all(abs(sum(r.distribution.values()) - 1) < 1e-9 for r in rows)
    last = rows[-1].distribution
    assert results.first().predicted_answer == max(sorted(last), key=last.get)

    class Broken(measure.ScriptedModel):
        def generate(self, *a, **k):
            raise OSError("down")

    broken = conditions.condition_a(q, Broken).first()
    assert not broken.success and "down" in broken.error
    results, states = conditions.condition_c(q, Broken, ["A", "B"])
    assert "down" in results.first().error and states.count() == 1
    assert conditions.versions()["condition_a"] == 1


def digest(*parts):
    import hashlib

    return hashlib.sha256(b"".join(parts)).hexdigest()


def binned(*vectors):
    import numpy as np

    return np.round(np.asarray(vectors, np.float32), 8).astype(np.float32).tobytes()


def test_identities_of_states_and_actions(spark):
    _, states = conditions.condition_c(asked(spark), lambda: measure.ScriptedModel(REPLY, "AB"), ["A", "B"], embedder=measure.HashEmbedder)
    rows = states.orderBy("position").collect()
    text = b"q:why {choices}?\0choices:A=x\0B=y\0"
    vectors = [r.embedding for r in rows]
    assert [r.node_id for r in rows] == [digest(text), *[digest(text, b"steps:", binned(*vectors[1 : k + 1])) for k in (1, 2, 3)]]
    assert [r.action_id_to_next for r in rows] == [*[digest(b"pos:%d\0" % k, b"step:", binned(vectors[k + 1])) for k in range(3)], None]
    embed = measure.HashEmbedder().embed_batch(["why {choices}?", "a", "b", "c"])
    assert [list(map(float, v)) for v in vectors] == [pytest.approx(list(map(float, v))) for v in embed]
    assert [r.action_metadata.step_text_len if r.action_metadata else None for r in rows] == [1, 1, 1, None]
    _, named = conditions.condition_c(asked(spark), lambda: measure.ScriptedModel(REPLY, "AB"), ["A", "B"], embedder=measure.HashEmbedder, id_in_hash=True)
    assert named.where("position = 0").first().node_id == digest(b"qid:q1\0", text)
    for bad in (lambda d: measure.action_hash(d, precision=0), lambda d: measure.state_hashes(d, "t", "e", 0)):
        with pytest.raises(ValueError):
            bad(states)


def test_reasoning_is_repaired_at_the_right_place(spark, tmp_path):
    class Late(measure.ScriptedModel):
        """No steps at first; a measurement that fails when first made."""

        def generate(self, prompt, **k):
            return REPLY if "could not be read" in prompt else ""

        def top_logprobs(self, prompt, k):
            mark = tmp_path / "failed"
            if "step 2" in prompt and "step 3" not in prompt and not mark.exists():
                mark.write_text("x")
                raise OSError("once")
            return super().top_logprobs(prompt, k)

    results, states = conditions.condition_c(asked(spark), lambda: Late(space="AB"), ["A", "B"])
    r = results.first()
    assert (r.success, r.repair_attempts, r.n_calls, r.n_steps_raw, states.count()) == (True, 2, 4, 3, 4)

    class Never(measure.ScriptedModel):
        def top_logprobs(self, prompt, k):
            raise OSError("never")

    results, states = conditions.condition_c(asked(spark), lambda: Never(REPLY), ["A", "B"])
    s = states.collect()
    assert not results.first().success and "a measurement failed" in results.first().error
    assert [(x.position, x.distribution, x.embedding, x.action_id_to_next) for x in s] == [(0, None, None, None)] and "measurement" in s[0].metadata.failure_reason
    with pytest.raises(ValueError):
        conditions.condition_a(asked(spark), measure.ScriptedModel, repairs=-1)


def test_samples_have_seeds_of_their_own(spark):
    class Seeded(measure.ScriptedModel):
        def generate(self, prompt, temperature=0.0, seed=None, **k):
            return f"{temperature}:{seed}"

    rows = measure.generate(asked(spark).withColumn("prompt", F.lit("p")), Seeded, samples=3, temperature=0.5, seed=7).orderBy("sample").collect()
    assert [r.response for r in rows] == ["0.5:7", "0.5:8", "0.5:9"]


def test_batches_are_repaired_one_by_one():
    class Batched:
        single = []

        def generate_batch(self, prompts, temperature=0.0, seeds=()):
            raise measure.ModelError("third", 2, [f"batch {p}" for p in prompts])

        def generate(self, prompt, **k):
            self.single.append(prompt)
            return f"single {prompt}"

    assert measure._batch(lambda p: Batched().generate_batch(p), list("abcd")) == ["batch a", "batch b", None, "batch d"]

    def atomic(p):
        raise OSError("all")

    assert measure._batch(atomic, [1, 2]) == [None, None]


def test_prefixes_and_batched_measurement(spark):
    told = spark.createDataFrame([("g", "same start one"), ("g", "same start two"), ("h", "x")], "g string, prompt string")
    with_prefix = measure.shared_prefix(told, "g")
    assert {(r.g, r.prefix) for r in with_prefix.collect()} == {("g", "same start "), ("h", "x")}

    class Prefixed(measure.ScriptedModel):
        def prefill(self, prefix):
            self.prefix = prefix

        def top_logprobs_batch(self, prompts, k):
            return [super(Prefixed, self).top_logprobs(p, k) if not p.endswith("two") else {"A": -1.0} for p in prompts]

        def top_logprobs(self, prompt, k):
            assert prompt.startswith(self.prefix)
            return super().top_logprobs(prompt, k)

    rows = measure.measure(with_prefix, Prefixed, "ABCD").collect()
    assert all(r.error is None and len(r.distribution) == 4 and r.truncated == [] for r in rows)


def test_draws_follow_the_softmax(spark):
    df = spark.range(20_000).select(F.col("id"), F.array(F.lit(0.0), F.lit(1.0), F.lit(-1.0)).alias("l"))
    share = {r.token: r["count"] / 20_000 for r in measure.sample_token(df, "l", ["id"], 0.5).groupBy("token").count().collect()}
    z = [1, math.exp(2), math.exp(-2)]
    assert all(abs(share[k] - z[k] / sum(z)) < 0.015 for k in range(3))
    assert measure.sample_token(df, "l", ["id"]).select("token").distinct().first().token == 1


def test_servers(monkeypatch):
    import io
    import json
    import urllib.error

    sent = []

    def answers(reply):
        def urlopen(request, timeout):
            sent.append(json.loads(request.data))
            if isinstance(reply, Exception):
                raise reply
            return io.BytesIO(reply if isinstance(reply, bytes) else json.dumps(reply).encode())

        monkeypatch.setattr(measure.urllib.request, "urlopen", urlopen)

    server, plain = measure.CompletionServer("http://x/v1", "m"), measure.TextServer("http://x/api", "m")
    answers({"choices": [{"text": "hi", "logprobs": {"top_logprobs": [{"A": -0.5}]}}]})
    assert server.generate("p", seed=9) == "hi" and sent[-1]["seed"] == 9 and server.top_logprobs("p", 4) == {"A": -0.5} and sent[-1]["logprobs"] == 4
    answers({"choices": [{"logprobs": {"content": [{"top_logprobs": [{"token": "B", "logprob": -1}]}]}}]})
    assert server.top_logprobs("p", 4) == {"B": -1.0}
    answers({"response": "text"})
    assert plain.generate("p", max_tokens=5, temperature=0.3, seed=1) == "text" and sent[-1]["options"] == {"temperature": 0.3, "seed": 1, "num_predict": 5}
    assert plain.metadata() == {"adapter_name": "TextServer", "model": "m"}
    with pytest.raises(measure.ModelError):
        plain.top_logprobs("p", 1)
    for reply, kind in ((urllib.error.HTTPError("u", 503, "busy", {}, None), measure.ModelStatus), (TimeoutError(), measure.ModelTimeout), (urllib.error.URLError("refused"), measure.ModelUnreachable), (urllib.error.URLError(TimeoutError()), measure.ModelTimeout), (b"<html>", measure.ModelReply), ({"choices": []}, measure.ModelReply)):
        answers(reply)
        with pytest.raises(kind):
            server.generate("p")


def test_measurement():
    class Sparse:
        asked = []

        def top_logprobs(self, prompt, k):
            self.asked.append(k)
            return {" A": math.log(0.5), "\nA": math.log(0.25)}

    got = measure.read_belief(Sparse(), "p", ["A", "B"])
    assert got["distribution"] == {"A": 1.0, "B": 0.0} and got["truncated"] == ["B"] and Sparse.asked == [40, 160]
    with pytest.raises(RuntimeError, match="no mass"):
        measure.read_belief(Sparse(), "p", ["Z"])


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "i int, text string")
    rows = measure.action_hash(measure.embed(df, measure.HashEmbedder)).orderBy("i").collect()
    assert rows[0].action_id == rows[2].action_id == digest(b"step:", binned(rows[0].embedding)) and rows[1].embedding is None and rows[1].action_id is None
    assert sum(x * x for x in rows[0].embedding) == pytest.approx(1, abs=1e-5)


def test_guards(spark):
    s = spark.createDataFrame([(1, 0, "n", [1.0], "{}"), (1, 2, "n", None, "{1}")], "trajectory_id int, position int, node_id string, embedding array<double>, metadata_json string")
    for check in (guards.embeddings_uniform, guards.metadata_consistent, guards.trajectories_whole):
        with pytest.raises(guards.GuardError):
            check(s)
    with pytest.raises(guards.GuardError):
        guards.weights_valid({"a": 0.5})
    mixed = spark.createDataFrame([({"model": "a"},), ({"model": "b"},)], "metadata map<string,string>")
    with pytest.raises(guards.GuardError):
        guards.one_provenance(mixed)
    guards.one_provenance(mixed, force=True)


def test_artifacts(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    states = spark.createDataFrame([("t", 0, "n", 0, '{" A": 0.5, "B": 0.5}')], "trajectory_id string, position int, node_id string, timestep int, hypothesis_distribution_json string")
    trajectories = spark.createDataFrame([("t", "A")], "trajectory_id string, primary_label string")
    artifacts.save_trajectories(trajectories, states, path, source_dataset="x")
    with pytest.raises(artifacts.ArtifactExists):
        artifacts.save_trajectories(trajectories, states, path)
    artifacts.save_trajectories(trajectories, states, path, overwrite=True)
    t, s = artifacts.load_trajectories(spark, path)
    assert t.first().primary_label == "A" and artifacts.decoded_states(s).first().distribution == {" A": 0.5, "B": 0.5}
    assert artifacts.nested(t, s).first().states[0].node_id == "n" and len(list(artifacts.iter_trajectories(spark, path))) == 1
    with pytest.raises(artifacts.ArtifactMissing):
        artifacts.load_graph(spark, f"{path}-none")
    with pytest.raises(artifacts.VersionMismatch):
        artifacts.load_graph(spark, path)
    visits = spark.createDataFrame([(0, "t", 0, "n", [1.0]), (1, "t", 1, "m", [1.0])], "visit_seq long, trajectory_id string, timestep int, node_id string, embedding array<float>")
    artifacts.save_visits(visits, f"file://{tmp_path}/visits")
    assert artifacts.load_visits(spark, f"file://{tmp_path}/visits").where("timestep = 1").first().node_id == "m"
    assert artifacts.load_visits(spark, f"file://{tmp_path}/none") is None
    with pytest.raises(artifacts.ArtifactError):
        artifacts.save_visits(visits.withColumn("visit_seq", F.lit(1)), f"file://{tmp_path}/visits")
    with pytest.raises(artifacts.ColumnsMissing):
        artifacts.save_scores(visits, f"file://{tmp_path}/scores", {})


def test_resume(spark, tmp_path):
    work = spark.createDataFrame([("a",), ("b",)], "question_id string")
    path, seen = f"file://{tmp_path}/log", []

    def process(todo):
        seen.append(sorted(r.question_id for r in todo.collect()))
        return todo.withColumn("v", F.lit(1))

    artifacts.resumed(spark, work.limit(1).where("question_id = 'a'"), path, process)
    assert artifacts.resumed(spark, work, path, process).count() == 2 and seen == [["a"], ["b"]]


def test_scratch_tables_go_at_the_end_of_the_block(spark):
    from pathlib import Path

    before = store.cut_lineage(spark.range(2), "kept")
    with store.scratch():
        inside = store.cut_lineage(spark.range(3), "inside")
        paths = [Path(f.removeprefix("file:")) for f in inside.inputFiles()]
        assert inside.count() == 3 and all(p.exists() for p in paths)
    assert paths and not any(p.exists() for p in paths) and before.count() == 2


def test_logged_parts_are_whole_and_once(spark, tmp_path):
    rows, path = spark.range(3).withColumnRenamed("id", "question_id"), f"file://{tmp_path}/log"
    assert artifacts.append_json(rows, path, "run-1-0") and not artifacts.append_json(rows, path, "run-1-0")
    (tmp_path / "log" / "_writing-x").mkdir()
    (tmp_path / "log" / "_writing-x" / "part-0.json").write_text('{"question_id": 99}\n')
    assert sorted(r.question_id for r in artifacts.read_log(spark, path).collect()) == [0, 1, 2]
    seen = []
    again = artifacts.resumed(spark, rows, path, lambda todo: seen.append(todo.count()) or todo, parts=1, run="run")
    assert again.count() == 3 and seen == []


def test_stream(spark, tmp_path):
    s = spark.createDataFrame([(1, {"A": 0.5, "B": 0.5}, 0.9), (1, {"A": 1.0}, 0.7)], "trajectory_id int, distribution map<string,double>, mass_capture double")
    s.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(s.schema).parquet(f"{tmp_path}/in")
    q = scoring.running_scores(stream).writeStream.format("memory").queryName("scores").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    r = spark.table("scores").first()
    assert (r.mean_entropy, r.n_states, r.mass_capture_min) == (0.5, 2, 0.7)


def test_signature_weights(spark):
    with pytest.raises(guards.GuardError):
        signatures.compute_signatures(None, None, None, None, None, weights={"entropy_plateau": 0.4})
