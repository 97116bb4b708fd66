"""Resampling against plain recomputation with the same counts."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import evaluate, prereg, resample, stats
from brindle.plans import extras
from brindle.plans import stats as plans

SF = "/root/testdata/sf0.001"


def area(score, pos, neg):
    ahead = sum(p * n * ((s > t) + 0.5 * (s == t)) for s, p in zip(score, pos) for t, n in zip(score, neg))  # noqa: B905
    return ahead / (sum(pos) * sum(neg)) if sum(pos) and sum(neg) else math.nan


def precision(score, pos, neg):
    out = 0.0
    for s, p in zip(score, pos, strict=True):
        tp, fp = sum(q for t, q in zip(score, pos, strict=True) if t >= s), sum(q for t, q in zip(score, neg, strict=True) if t >= s)
        out += p * tp / (tp + fp) if p else 0
    return out / sum(pos)


@pytest.fixture(scope="module")
def units(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 12)), float(rng.normal()), int(rng.random() < 0.4)) for i in range(60)]
    return rows, spark.createDataFrame(rows, "unit long, a double, b double, target int")


@pytest.mark.parametrize("per_range", [1000, 5])
def test_areas_of_the_drawn_counts(spark, units, per_range):
    rows, df = units
    long = df.select(F.lit("s").alias("score_column"), F.col("a").alias("score"), "target").unionByName(spark.createDataFrame([("s", None, 1)], "score_column string, score double, target int"))
    got = {r.replicate: (r.roc_auc, r.pr_auc) for r in resample.bootstrap_areas(long, ["score_column"], 30, 7, per_range).collect()}
    score = sorted({r[1] for r in rows})
    for b in range(30):
        pos, neg = [], []
        for cut in range(0, len(score), per_range):
            own = score[cut : cut + per_range]
            rng = np.random.default_rng([7, cut // per_range, b])
            count = lambda y: np.array([sum(r[1] == s and r[3] == y for r in rows) for s in own])  # noqa: B023, E731
            pos += rng.poisson(count(1)).tolist()
            neg += rng.poisson(count(0)).tolist()
        assert got[b] == (pytest.approx(area(score, pos, neg)), pytest.approx(precision(score, pos, neg)))


@pytest.mark.parametrize("per_range", [1000, 7])
def test_paired_areas_and_ranks_see_the_same_counts(spark, units, per_range):
    rows, df = units
    hashes = np.array([r.h for r in df.select("unit", F.xxhash64("unit").alias("h")).orderBy("unit").collect()], np.int64)
    delta = {r.replicate: r.delta for r in resample.paired_bootstrap(df, "unit", "a", "b", n=120, seed=5, per_range=per_range).collect()}
    rho = {r.replicate: r.rho for r in resample.spearman_bootstrap(df, "unit", "a", "b", n=120, seed=5, per_range=per_range).collect()}
    y = np.array([r[3] for r in rows])
    for b in (0, 1, 99, 100, 119):
        w = resample.unit_counts(hashes, b, 5)
        areas = [area([r[k] for r in rows], (w * y).tolist(), (w * (1 - y)).tolist()) for k in (1, 2)]
        assert delta[b] == pytest.approx(areas[0] - areas[1])
        again = [np.repeat([r[k] for r in rows], w) for k in (1, 2)]
        ranks = [(x[:, None] > x).sum(1) + (x[:, None] == x).sum(1) / 2 for x in again]
        assert rho[b] == pytest.approx(np.corrcoef(*ranks)[0, 1])
    assert len(delta) == len(rho) == 120


def test_counts_are_poisson():
    w = resample.unit_counts(np.arange(200_000), 3, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.005
    assert not np.array_equal(w, resample.unit_counts(np.arange(200_000), 4, 42))


def test_intervals_follow_the_point(spark):
    low = spark.range(200).select(F.lit("s").alias("score_column"), F.pmod(F.col("id") * 37, F.lit(200)).cast("double").alias("score"), (F.pmod(F.col("id") * 37, F.lit(200)) < F.pmod("id", F.lit(150))).cast("int").alias("target"))
    row = evaluate.deferral_auc(low, compute_ci=True, n_bootstrap=400).first()
    assert row.roc_auc < 0.5 and row.direction == "less" and row.roc_auc_ci_high < 0.5
    assert 0.5 < row.roc_auc_sign_aware_ci_low < row.roc_auc_sign_aware < row.roc_auc_sign_aware_ci_high
    assert row.roc_auc_sign_aware_ci_low == pytest.approx(1 - row.roc_auc_ci_high)
    assert row.pr_auc_ci_low < row.pr_auc < row.pr_auc_ci_high
    told = evaluate.auc_with_ci(low, n_bootstrap=400).first()
    assert (told.ci_low, told.ci_high) == (row.roc_auc_sign_aware_ci_low, row.roc_auc_sign_aware_ci_high)
    one = evaluate.auc_with_ci(low.withColumn("target", F.lit(1)), n_bootstrap=20).first()
    assert math.isnan(one.sign_aware) and one.direction == "?" and math.isnan(one.ci_low)


def test_interval_covers_like_the_normal_one(spark):
    """Hanley and McNeil's standard error as a yardstick."""
    rng = np.random.default_rng(1)
    rows = [("s", float(rng.normal(0.5 * (i % 2))), i % 2) for i in range(1000)]
    row = evaluate.deferral_auc(spark.createDataFrame(rows, "score_column string, score double, target int"), compute_ci=True, n_bootstrap=1000).first()
    a, n = row.roc_auc, 500
    se = math.sqrt((a * (1 - a) + (n - 1) * (a / (2 - a) - a * a) + (n - 1) * (2 * a * a / (1 + a) - a * a)) / n / n)
    assert row.roc_auc_ci_high - row.roc_auc_ci_low == pytest.approx(2 * 1.96 * se, rel=0.15)


def test_component_table_and_comparisons(spark):
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.normal(size=4)), 0.5) for i in range(80)]
    scores = spark.createDataFrame(rows, "trajectory_id long, entropy_plateau double, voi_flatness double, distance_from_trajectory double, composite double, deferral_signal double")
    truth = spark.createDataFrame([(i, i % 2) for i in range(80)], "trajectory_id long, target int")
    table = {r.score_column: r for r in evaluate.component_table(scores, truth, n_bootstrap=50).collect()}
    assert set(table) == set(evaluate.COMPONENTS) and all(r.roc_auc_ci_low <= r.roc_auc <= r.roc_auc_ci_high for r in table.values())
    by = evaluate.grouped_comparison({"m1": scores, "m2": scores.where("trajectory_id < 40")}, truth, "llm_name", compute_ci=False)
    assert {r.llm_name: r.n_pos + r.n_neg for r in by.collect()} == {"m1": 80, "m2": 40}
    by = evaluate.grouped_comparison({"A": scores, "C": scores}, truth, "condition_id", evaluate.CONDITION_SCORES, truth.where("trajectory_id < 30"), compute_ci=False)
    assert {(r.condition_id, r.score_column): (r.n_pos, r.roc_auc == 0.5) for r in by.collect()} == {("A", "deferral_signal"): (15, True), ("C", "composite"): (15, False)}
    by = evaluate.grouped_comparison({"d1": scores}, {"d1": truth}, "domain_name", compute_ci=False)
    assert by.first().domain_name == "d1"
    for bad in (lambda: evaluate.grouped_comparison({"d1": scores}, {"d2": truth}, "domain_name"), lambda: evaluate.grouped_comparison({"Z": scores}, truth, "c", evaluate.CONDITION_SCORES), lambda: evaluate.long_scores(scores, truth.where("target = 1"), ["composite"]), lambda: evaluate.long_scores(scores.where("trajectory_id < 0"), truth, ["composite"])):
        with pytest.raises(evaluate.EvaluationError):
            bad()


@pytest.mark.parametrize("name, n", [("boot_auc_folded", 5000), ("paired_bootstrap", 2000)])
def test_production_resample_counts(spark, name, n):
    assert plans.QUERIES[name](spark, SF).first().n == n


@pytest.mark.parametrize("n1, n0", [(4, 5), (3, 3), (6, 4), (1, 5)])
def test_ks_chance_is_exact(spark, n1, n0):
    places = list(combinations(range(n1 + n0), n1))

    def apart(chosen):
        i = j = 0
        most = 0.0
        for k in range(n1 + n0):
            i, j = i + (k in chosen), j + (k not in chosen)
            most = max(most, abs(i / n1 - j / n0))
        return most

    found = [apart(set(c)) for c in places]
    for d in sorted(set(found)):
        assert stats.ks_exact(d, n1, n0) == pytest.approx(np.mean([x >= d - 1e-12 for x in found]))


def test_ks_chance_of_large_samples():
    x = 0.05 * math.sqrt(5000 * 4000 / 9000)
    assert stats.ks_exact(0.05, 5000, 4000) == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 50)), rel=0.05)


def test_trajectories_are_made_once_for_resampling(spark, monkeypatch):
    """The rows of spearman_ci and paired_bootstrap are written, and made of
    states that are: their plans read no table of the star schema."""
    read = []
    for name in ("spearman_bootstrap", "paired_bootstrap"):
        drawn = getattr(resample, name)
        monkeypatch.setattr(resample, name, lambda rows, *a, drawn=drawn: read.append(rows.inputFiles()) or drawn(rows, *a, n=100))
    plans.spearman_interval(spark, SF).collect()
    plans.paired_bootstrap(spark, SF).collect()
    assert len(read) == 2 and not [f for files in read for f in files if SF in f]


def test_each_group_has_a_task(spark):
    rows = spark.range(24_000).select(F.col("id"), F.pmod("id", F.lit(24)).alias("_cut"))
    dealt, by = resample._in_tasks(rows, ["_cut"])
    found = dealt.select(*by, F.spark_partition_id().alias("p")).distinct().groupBy("p").count()
    assert found.count() >= 20 and found.agg(F.max("count")).first()[0] <= 2


def test_counts_by_the_first_bits_are_those_of_the_share():
    units = np.concatenate([np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 300_000), np.arange(3)])
    for b in (0, 7, 1999):
        with np.errstate(over="ignore"):
            own = resample._mixed(np.array([(b + 1) * resample.GAMMA + 42 & 0xFFFFFFFFFFFFFFFF], np.uint64))
        share = (resample._mixed(units.view(np.uint64) ^ own) >> np.uint64(11)) / float(1 << 53)
        assert np.array_equal(resample.unit_counts(units, b, 42), np.searchsorted(resample.POISSON, share, "right"))


def test_areas_without_precision_are_drawn_once(spark, units, monkeypatch):
    """auc_with_ci has no PR area, so no range is drawn again for it; its areas
    are those of the draws with precision."""
    written, cut = [], resample.cut_lineage
    monkeypatch.setattr(resample, "cut_lineage", lambda df, name: written.append(name) or cut(df, name))
    long = units[1].select(F.lit("s").alias("score_column"), F.col("b").alias("score"), "target")
    evaluate.auc_with_ci(long, n_bootstrap=20).collect()
    assert "resampled" in written and "below" not in written
    drawn = [resample.bootstrap_areas(long, ["score_column"], 30, 7, 5, precision=p).orderBy("replicate") for p in (True, False)]
    assert [r.roc_auc for r in drawn[0].collect()] == [r.roc_auc for r in drawn[1].collect()] and "pr_auc" not in drawn[1].columns
    none = resample.bootstrap_areas(long.where("score is null"), ["score_column"], 30, 7, precision=False)
    assert none.count() == 0


def test_large_ranges_have_the_areas_of_their_counts(spark):
    """Two ranges of several pieces, with scores of many units and of both
    classes: a replicate's areas against those of all counts together."""
    n, per_range = 100_000, 60_000
    of = lambda i: (np.where(i % 3 == 0, 1 + (i % 50 == 0) * 30, 0), np.where((i % 3 != 0) | (i % 7 == 0), 1 + (i % 11 == 0), 0))
    pos, neg = of(np.arange(n))
    units = spark.range(n).withColumn("pos", F.when(F.expr("id % 3 = 0"), F.expr("if(id % 50 = 0, 31, 1)")).otherwise(0)).withColumn("neg", F.when(F.expr("id % 3 <> 0 or id % 7 = 0"), F.expr("if(id % 11 = 0, 2, 1)")).otherwise(0))
    long = units.select(F.lit("s").alias("score_column"), F.col("id").cast("double").alias("score"), F.explode(F.expr("concat(array_repeat(1, pos), array_repeat(0, neg))")).alias("target"))
    got = {r.replicate: (r.roc_auc, r.pr_auc) for r in resample.bootstrap_areas(long, ["score_column"], 2, 5, per_range).collect()}
    for b in (0, 1):
        drawn = np.zeros((2, n), np.int64)
        for cut in (0, 1):
            rng, end = np.random.default_rng([5, cut, b]), min(n, (cut + 1) * per_range)
            for i in reversed(range(cut * per_range, end, resample.PIECE)):
                at = np.arange(i, min(end, i + resample.PIECE))
                where = [(k, at[x[at] > 0]) for k, x in enumerate((pos, neg))]
                means = np.concatenate([(pos, neg)[k][w] for k, w in where])
                counts = resample.single_counts(rng, len(means), resample.rooms()).copy()
                counts[means > 1] = rng.poisson(means[means > 1])
                (_, a), (_, z) = where
                drawn[0, a], drawn[1, z] = counts[: len(a)], counts[len(a) :]
        p, q = drawn
        assert abs(p.sum() / pos.sum() - 1) < 0.02 and abs(q.sum() / neg.sum() - 1) < 0.02 and not p[pos == 0].any() and not q[neg == 0].any()
        tp, fp = np.cumsum(p[::-1])[::-1], np.cumsum(q[::-1])[::-1]
        assert got[b][0] == pytest.approx((p * (np.cumsum(q) - q / 2)).sum() / p.sum() / q.sum(), rel=1e-12)
        assert got[b][1] == pytest.approx((p * tp / np.maximum(tp + fp, 1)).sum() / p.sum(), rel=1e-12)


def test_single_counts_are_those_of_the_share():
    k, room = 2 * resample.PIECE - 3, resample.rooms()
    seen = np.zeros(8)
    for seed in range(20):
        got = resample.single_counts(np.random.default_rng(seed), k, room)
        raw = np.random.default_rng(seed).bit_generator
        first = raw.random_raw(-(-k // 4)).view(np.uint16)[:k].astype(np.uint64)
        low, high = (np.searchsorted(resample.POISSON, (first + e) / 65536, "right") for e in (0, 1 - 2.0**-37))
        assert np.array_equal(got[low == high], low[low == high]) and ((low <= got) & (got <= high)).all()
        rest = np.flatnonzero(resample._FIRST[first.astype(int)] == 255)
        share = (((first[rest] << np.uint64(48)) | (raw.random_raw(len(rest)) >> np.uint64(16))) >> np.uint64(11)) / float(1 << 53)
        assert np.array_equal(got[rest], np.searchsorted(resample.POISSON, share, "right"))
        seen += np.bincount(np.minimum(got, 7), minlength=8)
    law = np.diff(np.concatenate([[0], resample.POISSON[:7], [1]])) * seen.sum()
    assert ((seen - law) ** 2 / law).sum() < 24.3  # one in a thousand


def test_rules_have_the_intervals_that_they_ask_for(spark, monkeypatch):
    given, rules = [], prereg.rules
    monkeypatch.setattr(prereg, "rules", lambda areas, facts: given.append((areas, facts)) or rules(areas, facts))
    of, long = evaluate.auc_with_ci, []
    monkeypatch.setattr(evaluate, "auc_with_ci", lambda rows, **k: long.append(rows) or of(rows, **k))
    told = extras.prereg_rules_ci(spark, SF).collect()
    areas, facts = given[0]
    low = {r.score_column: r.ci_low for r in areas.collect()}
    asked = {*prereg.DISABLED, *prereg.ENABLED} & set(extras.FEATURES)
    assert set(low) == set(extras.FEATURES) and {c for c, x in low.items() if x is not None} == asked
    every = of(long[0])
    assert every.where("ci_low is null").isEmpty()
    assert len(told) == 10 and sorted(told) == sorted(rules(every, facts).select("rule", "measured", "held").collect())
