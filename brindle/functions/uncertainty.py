"""Column functions over distributions (maps) and top-K log-probability lists.

Lists hold natural log-probabilities in any order. All functions stay in the
JVM; an empty or null input gives the documented default.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RESIDUAL_FLOOR = 1e-9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often it occurs."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _probs(logprobs: Column) -> Column:
    return F.transform(logprobs, lambda x: F.exp(x))


def _plogp(p: Column, log) -> Column:
    return F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x * log(x))


def entropy_bits(dist: Column) -> Column:
    """-sum p log2 p over positive entries; not renormalized."""
    return _plogp(F.map_values(dist), F.log2)


def entropy_nats(dist: Column) -> Column:
    return _plogp(F.map_values(dist), F.ln)


def mass(dist: Column) -> Column:
    return _sum(F.map_values(dist))


def renormalized(dist: Column) -> Column:
    """Each entry over the sum of all; a sum of zero raises."""
    total = mass(dist)
    return F.when(total > 0, F.transform_values(dist, lambda k, v: v / total)).otherwise(F.raise_error(F.lit("no mass on the token set")).cast("map<string,double>"))


def alias_mass(tokens: Column, space: list[str]) -> Column:
    """For each answer of ``space`` the sum of the probabilities of its three
    token forms: bare, after a space, after a line feed."""
    entry = lambda a: sum((F.coalesce(F.try_element_at(tokens, F.lit(p + a)), F.lit(0.0)) for p in ("", " ", "\n")), F.lit(0.0))
    return F.map_from_arrays(F.array(*map(F.lit, space)), F.array(*map(entry, space)))


def truncated_members(tokens: Column, space: list[str]) -> Column:
    """The answers none of whose token forms is in the top K."""
    forms = lambda a: F.array(*[F.concat(F.lit(p), a) for p in ("", " ", "\n")])
    return F.filter(F.array(*map(F.lit, space)), lambda a: ~F.arrays_overlap(forms(a), F.map_keys(tokens)))


def p_max(logprobs: Column) -> Column:
    return F.coalesce(F.exp(F.array_max(logprobs)), F.lit(0.0))


def chosen_logprob(logprobs: Column) -> Column:
    return F.array_max(logprobs)


def entropy_full(logprobs: Column) -> Column:
    """Entropy in nats with what the top K leave as one further outcome."""
    p = _probs(logprobs)
    rest = F.greatest(F.lit(0.0), 1 - _sum(p))
    return F.coalesce(_plogp(p, F.ln) + F.when(rest > RESIDUAL_FLOOR, -rest * F.ln(rest)).otherwise(0.0), F.lit(0.0))


def _descending(logprobs: Column) -> Column:
    return F.sort_array(_probs(logprobs), asc=False)


def top_k_mass(logprobs: Column, k: int = 10) -> Column:
    return F.coalesce(_sum(F.slice(_descending(logprobs), 1, k)), F.lit(0.0))


def gap_top2(logprobs: Column) -> Column:
    return gap_top1_top_k(logprobs, 2)


def gap_top1_top_k(logprobs: Column, k: int = 10) -> Column:
    """The largest probability less the k-th; 0 with fewer than k."""
    p = _descending(logprobs)
    return F.coalesce(F.when(F.size(p) >= k, F.get(p, F.lit(0)) - F.get(p, F.lit(k - 1))), F.lit(0.0))


def entropy_full_renormalized(logprobs: Column) -> Column:
    p = _probs(logprobs)
    total = _sum(p)
    return _plogp(F.transform(p, lambda x: x / total), F.ln)


def varentropy(logprobs: Column) -> Column:
    """Variance of surprisal (nats) over the renormalized top K."""
    p = _probs(logprobs)
    total = _sum(p)
    q = F.filter(F.transform(p, lambda x: x / total), lambda x: x > 0)
    mean = _plogp(p=q, log=F.ln)
    return F.aggregate(q, F.lit(0.0), lambda a, x: a + x * (-F.ln(x) - mean) * (-F.ln(x) - mean))


def projected(dist: Column, space: list[str], empty: str = "uniform") -> Column:
    """Probabilities of ``space`` in order, renormalized. With no mass:
    uniform, or null for empty='null'."""
    raw = F.array(*[F.coalesce(F.try_element_at(dist, F.lit(a)), F.lit(0.0)) for a in space])
    total = _sum(raw)
    flat = F.array(*[F.lit(1.0 / len(space))] * len(space)) if empty == "uniform" else F.lit(None).cast("array<double>")
    return F.when(total > 0, F.transform(raw, lambda x: x / total)).otherwise(flat)


def entropy_of_list(probs: Column) -> Column:
    return _plogp(probs, F.log2)


def one_hot(answer: Column, space: list[str]) -> Column:
    """1 on the answer and 0 elsewhere; uniform for no or another answer."""
    known = F.coalesce(answer.isin(space), F.lit(False))
    return F.map_from_arrays(F.array(*map(F.lit, space)), F.array(*[F.when(known, (answer == a).cast("double")).otherwise(1.0 / len(space)) for a in space]))


def confidence_weighted(answer: Column, confidence: Column, space: list[str]) -> Column:
    """``confidence`` on the answer, the rest even on the others; uniform
    without an answer or a confidence; one option has all."""
    if len(space) == 1:
        return F.map_from_arrays(F.array(F.lit(space[0])), F.array(F.lit(1.0)))
    known = F.coalesce(answer.isin(space), F.lit(False)) & confidence.isNotNull()
    value = lambda a: F.when(known, F.when(answer == a, confidence).otherwise((1 - confidence) / (len(space) - 1))).otherwise(1.0 / len(space))
    return F.map_from_arrays(F.array(*map(F.lit, space)), F.array(*map(value, space)))


def argmax(dist: Column) -> Column:
    """The key of the largest value; the least key of several."""
    entries = F.transform(F.map_entries(dist), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.get(F.array_sort(entries), F.lit(0))["k"]


def js_divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence in bits of two aligned lists."""
    term = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)
    both = lambda a, b: term(a, (a + b) / 2) + term(b, (a + b) / 2)
    return F.when(p.isNotNull() & q.isNotNull(), F.greatest(F.lit(0.0), _sum(F.zip_with(p, q, both)) / 2))


def mean_pairwise(items: Column, distance: Callable[[Column, Column], Column]) -> Column:
    """Mean of ``distance`` over all unordered pairs i < j of an array; 0 with
    fewer than two items."""

    def mean(x: Column) -> Column:
        n = F.size(x)
        row = lambda i: F.aggregate(F.slice(x, i + 2, F.greatest(n - i - 1, F.lit(0))), F.lit(0.0), lambda b, q: b + distance(F.get(x, i), q))
        total = F.aggregate(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.lit(0.0), lambda a, i: a + row(i))
        return F.when(n > 1, total / (n * (n - 1) / 2)).otherwise(0.0)

    return _let(items, mean)


def l1_distance(p: Column, q: Column) -> Column:
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval; NaN without trials."""
    p = k / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    nan = F.lit(float("nan"))
    return F.when(n > 0, centre - half).otherwise(nan), F.when(n > 0, centre + half).otherwise(nan)


#: Normal quantile at 0.95, for one-sided 95% bounds.
Z_ONE_SIDED = 1.6448536269514722


def flagged(score: Column, threshold: float | Column, direction: str = "greater") -> Column:
    if direction not in ("greater", "less"):
        raise ValueError(f"direction must be 'greater' or 'less', not {direction!r}")
    return score >= threshold if direction == "greater" else score <= threshold


def clipped(score: Column) -> Column:
    """``score`` in [0, 1]; values beyond by more than 1e-6 raise."""
    outside = (score < -1e-6) | (score > 1 + 1e-6)
    return F.when(outside, F.raise_error(F.lit("score outside [0, 1]")).cast("double")).otherwise(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def present(value: Column) -> Column:
    """Neither null nor NaN, as pandas' notna has it."""
    return value.isNotNull() & ~F.isnan(value)


def normal_cdf_two_sided(z: Column) -> Column:
    """2 * (1 - Phi(|z|)) by the erfc expansion of Numerical Recipes
    (relative error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # The Chebyshev coefficients of the approximation.
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(c[-1])
    for a in reversed(c[:-1]):
        poly = F.lit(a) + t * poly
    return t * F.exp(-x * x + poly)
