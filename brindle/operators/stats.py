"""Statistics: ranks, effect sizes, tests, resampling, cross-validation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.uncertainty import normal_cdf_two_sided
from brindle.operators.ordered import ordered_sums, rank_percentiles
from brindle.sources.store import cut_lineage


def spearman(rows: DataFrame, unit: str, a: str, b: str) -> DataFrame:
    """Pearson's correlation of average-tie ranks, one row."""
    ranks = rank_percentiles(rows, unit, {"ra": F.col(a), "rb": F.col(b)})
    return ranks.agg(F.corr("ra", "rb").alias("rho"), F.count("*").alias("n"))


def spearman_matrix(rows: DataFrame, unit: str, columns: list[str]) -> DataFrame:
    """a, b, rho for all pairs of columns, from one pass of ranking."""
    ranks = rank_percentiles(rows, unit, {c: F.col(c) for c in columns})
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = ranks.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])))


def cohen_d(rows: DataFrame, value: str, target: str = "target") -> DataFrame:
    """Mean of class 1 less that of class 0 over the pooled sd; 0 without
    spread."""
    g = lambda f, t: f(F.when(F.col(target) == t, F.col(value)))
    s = rows.agg(*[g(f, t).alias(f"{n}{t}") for t in (0, 1) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    pooled = F.sqrt(F.try_divide((F.col("n0") - 1) * F.col("v0") + (F.col("n1") - 1) * F.col("v1"), F.col("n0") + F.col("n1") - 2))
    return s.select(F.when(pooled > 0, (F.col("m1") - F.col("m0")) / pooled).otherwise(0.0).alias("d"), "n0", "n1")


def two_samples(rows: DataFrame, value: str, target: str = "target") -> DataFrame:
    """Distinct values with counts by class and the counts below."""
    g = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.sum(target).cast("long").alias("pos"), F.sum(1 - F.col(target)).cast("long").alias("neg")).withColumn("key", F.lit(0))
    return ordered_sums(g, ["key"], value, ["pos", "neg"])


def mann_whitney_exact(u: float, n1: int, n0: int) -> float:
    """The two-sided chance of a U as far out, without ties: the number of
    arrangements by U, counted class by class."""
    ways = np.ones(1)  # by U, of n1 and j values
    for j in range(1, n0 + 1):
        wide = np.zeros(n1 * j + 1)
        # Gaussian binomials: times 1 - q^(n1 + j), over 1 - q^j.
        wide[: len(ways)] = ways
        up = np.concatenate([wide, np.zeros(n1 + j)])
        up[n1 + j :] -= wide
        for k in range(j, len(up)):
            up[k] += up[k - j]
        ways = up[: n1 * j + 1]
    far = max(u, n1 * n0 - u)
    return float(min(1.0, 2 * ways[round(far) :].sum() / ways.sum()))


def mann_whitney(rows: DataFrame, value: str, target: str = "target") -> DataFrame:
    """U of class 1, and the two-sided p of the normal approximation with tie
    and continuity corrections. p_exact counts arrangements where the smaller
    class has 8 values at most, the larger 1,000, and there are no ties; it is
    the approximation's p elsewhere."""
    t = two_samples(rows, value, target)
    n = F.col("pos") + F.col("neg")
    s = t.agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("n1"), F.sum("neg").alias("n0"), F.sum(n.cast("double") ** 3 - n).alias("ties"))
    total, mean = F.col("n1") + F.col("n0"), F.col("n1") * F.col("n0") / 2
    var = F.col("n1") * F.col("n0") / 12.0 * ((total + 1) - F.col("ties") / (total * (total - 1)))
    z = F.try_divide(F.greatest(F.abs(F.col("u") - mean) - 0.5, F.lit(0.0)), F.sqrt(var))  # null if all are tied

    @F.pandas_udf("double")
    def exact(u: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series) -> pd.Series:
        few = lambda a, b: 0 < min(a, b) <= 8 and max(a, b) <= 1000
        return pd.Series([mann_whitney_exact(float(x), int(a), int(b)) if few(a, b) and t == 0 else None for x, a, b, t in zip(u, n1, n0, ties, strict=True)], dtype=float)

    p = normal_cdf_two_sided(z)
    return s.select("u", "n1", "n0", z.alias("z"), p.alias("p"), F.coalesce(exact("u", "n1", "n0", "ties"), p).alias("p_exact"))


def ks_two_sample(rows: DataFrame, value: str, target: str = "target") -> DataFrame:
    """The largest distance d of the classes' distribution functions, and the
    chance p of one as large: exact up to 10,000 values a class, then by the
    limiting law, which p_limit has in any case."""
    t = two_samples(rows, value, target)
    share = lambda c: F.try_divide(F.col(f"before_{c}") + F.col(c), F.col(f"total_{c}"))
    found = t.agg(F.max(F.abs(share("pos") - share("neg"))).alias("d"), F.first("total_pos").alias("n1"), F.first("total_neg").alias("n0"))
    x = F.col("d") * F.sqrt(F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0")))
    limit = sum((2 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * x * x) for k in range(1, 101)), F.lit(0.0))

    @F.pandas_udf("double")
    def exact(d: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
        return pd.Series([ks_exact(float(x), int(a), int(b)) if max(a, b) <= 10_000 else None for x, a, b in zip(d, n1, n0, strict=True)], dtype=float)

    p_limit = F.when(x < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), limit)))
    found = found.where("n1 > 0 and n0 > 0").withColumn("p_limit", p_limit)
    return found.select("d", "n1", "n0", "p_limit", F.coalesce(exact("d", "n1", "n0"), "p_limit").alias("p"))


def ks_exact(d: float, n1: int, n0: int) -> float:
    """The chance that two samples of one law are ``d`` or more apart: the
    share of lattice paths that leave the band, counted row by row."""
    bound = round(d * n1 * n0)  # |i * n0 - j * n1| of a path that stays inside is less
    if bound <= 0:
        return 1.0
    row, low, scale = np.ones(min(n0, (bound - 1) // n1) + 1), 0, 0.0
    for i in range(1, n1 + 1):
        first = max(0, (i * n0 - bound) // n1 + 1)
        last = min(n0, (i * n0 + bound - 1) // n1)
        if first > last:
            return 1.0
        wide = np.zeros(last - low + 1)
        wide[: len(row)] = row
        row, low = np.cumsum(wide[first - low :]), first
        top = row.max()
        if top == 0:
            return 1.0
        row, scale = row / top, scale + np.log(top)
    total = math.lgamma(n1 + n0 + 1) - math.lgamma(n1 + 1) - math.lgamma(n0 + 1)
    return float(min(1.0, max(0.0, 1 - math.exp(scale + np.log(row[n0 - low]) - total))))


def ecdf(rows: DataFrame, value: str) -> DataFrame:
    """Distinct values with the share of rows at or below them."""
    g = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).withColumn("key", F.lit(0))
    return ordered_sums(g, ["key"], value, ["n"]).select(value, ((F.col("before_n") + F.col("n")) / F.col("total_n")).alias("share"))


def standardized(rows: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by the population sd, as z_<column>; no spread gives 0."""
    m = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]).withColumn("_k", F.lit(0))
    wide = rows.withColumn("_k", F.lit(0)).join(F.broadcast(m), "_k")  # one row
    z = [F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0).alias(f"z_{c}") for c in columns]
    return wide.select(*rows.columns, *z)


#: Newton steps and the largest change of a coefficient that ends them.
STEPS, CLOSE = 50, 1e-10


def _solved(sums: dict, theta: np.ndarray, used: np.ndarray, penalty: float) -> np.ndarray:
    """Newton's step at ``theta`` from a fold's sums; the first coefficient is
    the intercept, which is free."""
    d = len(theta)
    pull = np.where(np.arange(d) > 0, penalty, 0.0)
    slope = np.array([sums[f"g{i}"] for i in range(d)]) + pull * theta
    curve = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            curve[i, j] = curve[j, i] = sums[f"h{i}_{j}"]
    curve += np.diag(np.where(used, pull, 1.0))
    return np.linalg.solve(curve, np.where(used, slope, 0.0))


def fold_coefficients(rows: DataFrame, models: dict[str, list[str]], target: str = "target", folds: int = 5, fold: str = "fold", penalty: float = 1.0) -> dict[tuple[str, int], list[float]]:
    """For each model and fold the intercept and coefficients of the L2
    logistic regression (``penalty`` is 1 / C) of the rows of other folds.

    All fits go on together: a Newton step is one pass over the rows, which
    gives the gradient and the Hessian of every model and fold; only these, a
    row a fit, come to the driver. At the start all folds of a model have the
    same coefficients, so theirs are the sums over all rows less the fold's
    own. A step that makes the loss larger is halved."""
    d = 1 + max(map(len, models.values()))
    used = {m: np.arange(d) <= len(f) for m, f in models.items()}
    x = {m: F.array(F.lit(1.0), *[F.col(c).cast("double") for c in f], *[F.lit(0.0)] * (d - 1 - len(f))) for m, f in models.items()}
    y = F.col(target).cast("double")

    def sums(which: list, own_fold: bool) -> list:
        fits = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(k).alias("k"), F.array(*[F.lit(float(t)) for t in theta]).alias("theta"), x[m].alias("x")) for m, k, theta in which])
        each = rows.select(F.col(fold).alias("_fold"), y.alias("y"), F.inline(fits))
        each = each if own_fold else each.where("_fold <> k")
        z = sum((F.col("theta")[i] * F.col("x")[i] for i in range(d)), F.lit(0.0))
        p = 1 / (1 + F.exp(-F.col("z")))
        each = each.withColumn("z", z).withColumn("p", p).withColumn("w", F.col("p") * (1 - F.col("p")))
        xi = [F.col("x")[i] for i in range(d)]
        loss = F.greatest(F.col("z"), F.lit(0.0)) + F.log1p(F.exp(-F.abs("z"))) - F.col("y") * F.col("z")
        measures = [F.sum(loss).alias("loss")] + [F.sum((F.col("p") - F.col("y")) * xi[i]).alias(f"g{i}") for i in range(d)] + [F.sum(F.col("w") * xi[i] * xi[j]).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
        return [r.asDict() for r in each.groupBy("model", F.col("_fold").alias("k") if own_fold else F.col("k")).agg(*measures).collect()]

    theta = {(m, k): np.zeros(d) for m in models for k in range(folds)}
    back, seen, step = {}, {}, 0
    first = sums([(m, -1, np.zeros(d)) for m in models], True)
    names = [n for n in first[0] if n not in ("model", "k")] if first else []
    now = []
    for m in models:
        own = {r["k"]: r for r in first if r["model"] == m}
        whole = {n: sum(r[n] for r in own.values()) for n in names}
        now += [{"model": m, "k": k} | {n: whole[n] - (own[k][n] if k in own else 0.0) for n in names} for k in range(folds)] if names else []
    while now and step < STEPS:
        step += 1
        going = []
        for r in now:
            at = r["model"], r["k"]
            value = r["loss"] + penalty / 2 * float((theta[at][1:] ** 2).sum())
            if at in seen and value > seen[at] + 1e-12 * abs(seen[at]) and np.abs(theta[at] - back[at]).max() > CLOSE:
                theta[at] = (theta[at] + back[at]) / 2
                going.append(at)
                continue
            move = _solved(r, theta[at], used[at[0]], penalty)
            seen[at], back[at] = value, theta[at]
            theta[at] = theta[at] - move
            if np.abs(move).max() > CLOSE:
                going.append(at)
        now = sums([(m, k, theta[m, k]) for m, k in going], False) if going else []
    return {(m, k): t[: 1 + len(models[m])].tolist() for (m, k), t in theta.items()}


def cv_probabilities(rows: DataFrame, models: dict[str, list[str]], target: str = "target", folds: int = 5, fold: str = "fold") -> DataFrame:
    """``rows`` with a column for each model: the probability by the fit that
    has not seen the row's fold. The fold is a column, 0 to ``folds`` - 1."""
    rows = cut_lineage(rows, "folds")  # every step reads it
    found = fold_coefficients(rows, models, target, folds, fold)

    def probability(m: str):
        theta = F.create_map(*[c for k in range(folds) for c in (F.lit(k), F.array(*[F.lit(t) for t in found[m, k]]))])[F.col(fold).cast("int")]
        return 1 / (1 + F.exp(-sum((theta[i + 1] * F.col(c) for i, c in enumerate(models[m])), theta[0])))

    return rows.select("*", *[probability(m).alias(m) for m in models])


def cv_logistic(rows: DataFrame, features: list[str], target: str = "target", folds: int = 5, fold: str = "fold") -> DataFrame:
    """Out-of-fold probabilities ``oof`` by L2 logistic regression (C = 1,
    free intercept)."""
    return cv_probabilities(rows, {"oof": features}, target, folds, fold)


def cv_areas(rows: DataFrame, models: dict[str, list[str]], target: str = "target", folds: int = 5, fold: str = "fold") -> DataFrame:
    """model, n_features and ROC area of the out-of-fold probabilities of each
    model's features, to 12 digits, so that no tie hangs on rounding."""
    from brindle.operators.evaluate import deferral_auc

    out = cv_probabilities(rows, models, target, folds, fold)
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(len(f)).alias("n_features"), F.round(m, 12).alias("score")) for m, f in models.items()])
    long = out.select(F.col(target).alias("target"), F.inline(each))
    return deferral_auc(cut_lineage(long, "models"), ["model", "n_features"]).select("model", "n_features", "roc_auc", "roc_auc_sign_aware", "direction")


#: Numbers of an array that noisy copies are compared in.
ROOM = 1 << 15


def noisy_spread(batch: pd.Series, sigma: float, copies: int, seed: int) -> pd.Series:
    """The spread of each list's noisy copies, for ``perturb_disagree``. Equal
    lists have equal noise, so each is made once."""
    import zlib

    low, high = np.triu_indices(copies, 1)
    codes, each = pd.factorize(np.array([np.asarray(p, float).tobytes() for p in batch], object))
    made, by_length = np.empty(len(each)), {}
    for i, p in enumerate(each):
        by_length.setdefault(len(p) // 8, []).append(i)
    for size, own in by_length.items():
        step = max(1, ROOM // max(1, len(low) * size))
        for at in range(0, len(own), step):
            these = own[at : at + step]
            noise = np.stack([np.random.default_rng([seed, zlib.crc32(each[i])]).normal(0, sigma, (copies, size)) for i in these])
            z = np.log(np.clip(np.stack([np.frombuffer(each[i]) for i in these]), 1e-12, None))[:, None, :] + noise
            q = np.exp(z - z.max(2, keepdims=True))
            q /= q.sum(2, keepdims=True)
            a, b = q[:, low], q[:, high]
            m = (a + b) / 2
            kl = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / m), 0).sum(2)  # noqa: B023, E731
            made[these] = ((kl(a) + kl(b)) / 2).mean(1)
    return pd.Series(made[codes])


def perturb_disagree(rows: DataFrame, dist: str, sigma: float, copies: int = 16, seed: int = 42) -> DataFrame:
    """``rows`` with the mean pairwise JS divergence (bits) of ``copies`` noisy
    softmax copies of the list ``dist``; noise is seeded by the list itself."""

    @F.pandas_udf("double")
    def spread(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield noisy_spread(batch, sigma, copies, seed)

    return rows.withColumn("perturb_disagree", spread(F.col(dist)))
