"""Bootstrap replicates of areas, area differences and rank correlations.

A replicate gives each unit a Poisson(1) count, which is the multinomial
resample with its total left free; areas and correlations are ratios, in which
that total cancels. Counts of different units are independent, so a replicate
needs no pass over all units: values are dealt out in ranges of about
``per_range`` in their order, each task draws the counts of its range and
returns sums, and the sums of the ranges, a row a (range, replicate), are put
together. Nothing is gathered on the driver and there is no limit of rows.

Where one score is resampled, units of equal score and class count together: a
sum of c counts is Poisson(c). Draws are made only of classes that a score has,
and areas that need no precision are made without it. Where two columns must see
the same counts, a unit's count comes from a hash of its key and the replicate;
units of equal value stay in one range then, in one task.

Replicates are numbered, and the same seed gives the same counts however the
rows are partitioned.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.uncertainty import present
from brindle.operators.ordered import ordered_sums
from brindle.sources.store import cut_lineage

PER_RANGE, BLOCK = 200_000, 100
GAMMA = 0x9E3779B97F4A7C15
#: Poisson(1)'s distribution function, up to where a double is 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])


#: What a 64-bit hash must reach for a count of 1, 2, ...
REACHED = np.array([math.ceil(p * (1 << 53)) << 11 for p in POISSON if math.ceil(p * (1 << 53)) < 1 << 53], np.uint64)
#: Counts by a hash's first 16 bits; 255 where the other bits decide.
_FIRST = np.searchsorted(REACHED, np.arange(1 << 16, dtype=np.uint64) << np.uint64(48), "right").astype(np.uint8)
_FIRST[(REACHED >> np.uint64(48)).astype(np.int64)] = 255
#: Units that are worked on at a time, so that they stay in a core's cache.
CHUNK = 1 << 14
#: Scores of a range that are drawn at a time: enough to outweigh numpy's calls,
#: and so few that what these allocate, at most 2 bytes a class's count, is reused
#: memory of the process (under 128 KB) and not asked of the system each time.
PIECE = 24_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer, in place."""
    other = x >> np.uint64(30)
    x ^= other
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=other)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=other)
    return x


def unit_counts(units: np.ndarray, replicate: int, seed: int) -> np.ndarray:
    """The counts of units, by 64-bit hashes of their keys, in a replicate, as
    bytes: a hash's share of 2^64 looked up in Poisson(1)'s distribution."""
    own = _mixed(np.array([(replicate + 1) * GAMMA + seed & 0xFFFFFFFFFFFFFFFF], np.uint64))
    keys, counts = units.astype(np.int64, copy=False).view(np.uint64), np.empty(len(units), np.uint8)
    for i in range(0, len(keys), CHUNK):
        h, c = _mixed(keys[i : i + CHUNK] ^ own), counts[i : i + CHUNK]
        _FIRST.take((h >> np.uint64(48)).view(np.int64), out=c, mode="clip")
        rest = np.flatnonzero(c == 255)
        c[rest] = np.searchsorted(REACHED, h[rest], "right")
    return counts


def rooms() -> tuple[np.ndarray, ...]:
    """Arrays for a task's draws and sums, used again for each replicate."""
    whole = [np.empty(2 * PIECE, kind) for kind in (np.intp, np.uint8, np.int64)]
    return *whole, np.zeros(PIECE + 1, np.int64), *[np.empty(PIECE, kind) for kind in (np.int64, np.int64, float, float)]


def single_counts(rng: np.random.Generator, k: int, room: tuple[np.ndarray, ...]) -> np.ndarray:
    """``k`` draws of Poisson(1), at most 2 * PIECE, in ``room``: 16 bits each,
    looked up; 48 more where these leave a count open."""
    index, found, counts = (x[:k] for x in room[:3])
    index[:] = first = rng.bit_generator.random_raw(-(-k // 4)).view(np.uint16)[:k]
    _FIRST.take(index, out=found, mode="clip")
    rest = np.flatnonzero(found == 255)
    more = rng.bit_generator.random_raw(len(rest)) >> np.uint64(16)
    found[rest] = np.searchsorted(REACHED, first[rest].astype(np.uint64) << np.uint64(48) | more, "right")
    counts[:] = found
    return counts


def _up_to(counts: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, ... counts."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def _ranged(rows: DataFrame, keys: list[str], value: str, per_range: int) -> DataFrame:
    """``rows`` with _cut, the number of their value's range in the key."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    place = ordered_sums(counts, keys, value, ["_n"]).select(*keys, value, F.floor(F.col("before__n") / per_range).cast("long").alias("_cut"))
    return cut_lineage(rows.join(place, [*keys, value]), "ranged")


def _runs(rows: DataFrame, keys: list[str], n: int) -> int:
    """How many replicates a task draws for its range: all, unless there are
    fewer ranges than twice the session's cores. Then a range goes to several
    tasks, so that what is copied is bounded by the cores and not by the rows.
    Every replicate has counts of its own, so this changes no result."""
    ranges = rows.select(*keys, "_cut").distinct().count()
    tasks = -(-2 * rows.sparkSession.sparkContext.defaultParallelism // max(1, ranges))
    return BLOCK * -(-n // (BLOCK * max(1, min(tasks, -(-n // BLOCK)))))


def _blocks(rows: DataFrame, n: int, run: int) -> DataFrame:
    """``rows`` once for each ``run`` of replicates."""
    return rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // run))))


def _in_tasks(dealt: DataFrame, by: list[str]) -> tuple[DataFrame, list[str]]:
    """``dealt`` with _task, the number of its group of ``by``, in ranges of
    it, so that tasks have a group each; and the columns to group by. Hashed,
    few large groups fall on some tasks together and leave others idle."""
    groups = [tuple(r) for r in dealt.select(*by).distinct().sort(*by).collect()]  # a row a range and run
    numbers = dealt.sparkSession.createDataFrame([(*g, i) for i, g in enumerate(groups)], dealt.select(*by, F.lit(0).alias("_task")).schema)
    return dealt.join(F.broadcast(numbers), by).repartitionByRange(max(1, len(groups)), "_task"), ["_task"]


def _of_block(block: int, n: int, run: int = BLOCK) -> range:
    return range(block * run, min(n, (block + 1) * run))


def _below(sums: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """``sums`` (a row a range and replicate) with below_<n>, the sum over
    lower ranges, and all_<n>, that over all."""
    order = Window.partitionBy(*keys, "replicate").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys, "replicate")
    return sums.select("*", *[F.coalesce(F.sum(x).over(order), F.lit(0.0)).alias(f"below_{x}") for x in names], *[F.sum(x).over(whole).alias(f"all_{x}") for x in names])


def _roc(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, replicate, roc_auc from the ranges' sums (p, n, area)."""
    found = _below(sums, keys, ["p", "n"])
    pairs = F.first(F.col("all_p") * F.col("all_n"))
    area = F.sum(F.col("area") + F.col("p") * F.col("below_n")) / pairs
    return found.groupBy(*keys, "replicate").agg(F.when(pairs > 0, area).otherwise(F.lit(float("nan"))).alias("roc_auc"))


def _pieces(part: pd.DataFrame) -> list[tuple]:
    """A range by PIECE scores, the highest first: how many scores have
    positives; their numbers, then those of scores with negatives; where a
    number is not 1; and how many scores with negatives are below each one
    with positives, and below or equal to it."""
    part = part.sort_values("score")
    every_pos, every_neg, found = part["pos"].to_numpy(), part["neg"].to_numpy(), []
    for i in reversed(range(0, len(part), PIECE)):
        pos, neg = every_pos[i : i + PIECE], every_neg[i : i + PIECE]
        has, places = np.flatnonzero(pos), _up_to(neg != 0)
        units = np.concatenate([pos[has], neg[neg != 0]])
        found.append((len(has), units, np.flatnonzero(units != 1), places[has], places[has + 1]))
    return found


def _totals(pieces: list[tuple], rng: np.random.Generator, room: tuple[np.ndarray, ...], precise: bool, p_above: float = 0.0, n_above: float = 0.0) -> tuple[float, float, float, float]:
    """Positives, negatives, area and sum of positives * precision of a range
    in a replicate, with ``p_above`` and ``n_above`` above it. A class's count
    at a score is a Poisson draw of its units there; a range of one piece
    leaves them all to numpy."""
    p = n = area = precision = 0.0
    for k, units, tied, low, high in pieces:
        if len(pieces) > 1:
            counts = single_counts(rng, len(units), room)
            counts[tied] = rng.poisson(units[tied])
        else:
            counts = rng.poisson(units)
        below, (x, y, pos, twice) = room[3][: len(units) - k + 1], (a[:k] for a in room[4:])
        np.cumsum(counts[k:], out=below[1:])
        pos[:] = counts[:k]
        below.take(low, out=x, mode="clip")
        if precise:
            ap = np.cumsum(pos[::-1])[::-1] + (p_above + p)
            precision += float(np.dot(pos, ap / np.maximum(ap + (below[-1] - x + (n_above + n)), 1)))
        x += below.take(high, out=y, mode="clip")
        twice[:] = x
        own = float(pos.sum())
        n += float(below[-1])
        area += float(np.dot(pos, twice)) / 2 - own * n
        p += own
    return p, n, area + p * n, precision


def bootstrap_areas(long: DataFrame, keys: list[str], n: int = 5000, seed: int = 42, per_range: int = PER_RANGE, precision: bool = True) -> DataFrame:
    """keys, replicate, roc_auc, pr_auc of ``n`` resamples of each key's units
    (score, target); missing scores are left out, and a resample of one class
    has NaN. Without ``precision`` there is no pr_auc, for which ranges below
    others are drawn a second time; roc_auc is the same."""
    kept = long.where(present(F.col("score")))
    groups = kept.groupBy(*keys, "score").agg(F.sum("target").cast("long").alias("pos"), F.sum(1 - F.col("target")).cast("long").alias("neg"))
    placed = ordered_sums(groups.withColumn("_one", F.lit(1)), keys, "score", ["_one"])
    ranged = cut_lineage(placed.select(*groups.columns, F.floor(F.col("before__one") / per_range).cast("long").alias("_cut")), "ranged")
    run = _runs(ranged, keys, n)
    dealt = _blocks(ranged, n, run)
    kinds = {f.name: f.dataType.simpleString() for f in groups.schema.fields}
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "_cut bigint", "replicate int", "p double", "n double", "area double", "precision double"])

    def drawn(part: pd.DataFrame):
        cut, pieces, room = int(part["_cut"].iloc[0]), _pieces(part), rooms()
        for b in _of_block(int(part["_block"].iloc[0]), n, run):
            yield cut, b, partial(_totals, pieces, np.random.default_rng([seed, cut, b]), room)

    def first(part: pd.DataFrame) -> pd.DataFrame:
        rows = [(cut, b, *totals(precision)) for cut, b, totals in drawn(part)]
        out = pd.DataFrame(rows, columns=["_cut", "replicate", "p", "n", "area", "precision"])
        for k in reversed(keys):
            out.insert(0, k, part[k].iloc[0])
        return out

    by = [*keys, "_cut", "_block"]
    tasked, task = _in_tasks(dealt, by)
    sums = cut_lineage(tasked.groupBy(*task).applyInPandas(first, schema), "resampled")
    roc = _roc(sums, keys)
    if not precision:
        return roc
    below = cut_lineage(_below(sums, keys, ["p", "n"]).withColumn("_block", F.floor(F.col("replicate") / run).cast("int")), "below")

    # Ranges with others above them count their precision again below those.
    def second(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        above = {r.replicate: (r.all_p - r.below_p - r.p, r.all_n - r.below_n - r.n) for r in right.itertuples()}
        rows = [(b, totals(True, *above[b])[3]) for _, b, totals in drawn(left)] if len(left) and len(right) else []
        out = pd.DataFrame(rows, columns=["replicate", "precision"])
        for k in reversed(keys):
            out.insert(0, k, right[k].iloc[0] if len(right) else None)
        return out

    alone = below.groupBy(*keys, "replicate").agg(F.count("*").alias("_ranges"), F.sum("precision").alias("precision"))
    parted = below.join(alone.where("_ranges > 1").select(*keys, "replicate"), [*keys, "replicate"], "left_semi")
    precise = alone.where("_ranges = 1").select(*keys, "replicate", "precision")
    if not parted.isEmpty():
        again = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "replicate int", "precision double"])
        more = dealt.groupBy(*by).cogroup(parted.groupBy(*by)).applyInPandas(second, again)
        precise = precise.unionByName(more.groupBy(*keys, "replicate").agg(F.sum("precision").alias("precision")))
    positives = sums.groupBy(*keys, "replicate").agg(F.sum("p").alias("p"))
    found = roc.join(precise, [*keys, "replicate"]).join(positives, [*keys, "replicate"])
    return found.select(*keys, "replicate", "roc_auc", F.when(F.isnan("roc_auc"), F.lit(float("nan"))).otherwise(F.col("precision") / F.col("p")).alias("pr_auc"))


def intervals(replicates: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the 2.5 and 97.5 percentiles: raw, turned like the point's
    direction (not clipped at 0.5), folded to max(a, 1 - a) by replicate, and
    of the PR area, if there is one; and how many replicates were not of one
    class."""
    rows = replicates.join(points.select(*keys, F.col("direction").alias("_way")), keys).where(~F.isnan("roc_auc"))
    a = F.col("roc_auc")
    turned = F.when(F.col("_way") == "less", 1 - a).otherwise(a)
    named = {"roc_auc": a, "roc_auc_sign_aware": turned, "roc_auc_folded": F.greatest(a, 1 - a)} | {x: F.col(x) for x in ("pr_auc",) if x in replicates.columns}
    ends = [F.percentile(v, q).alias(f"{x}_ci_{e}") for x, v in named.items() for e, q in (("low", 0.025), ("high", 0.975))]
    return rows.groupBy(*keys).agg(*ends, F.count("*").alias("n_replicates"))


def paired_bootstrap(rows: DataFrame, unit: str, a: str, b: str, target: str = "target", n: int = 2000, seed: int = 42, per_range: int = PER_RANGE) -> DataFrame:
    """replicate, delta: ROC area of ``a`` less that of ``b``, on the same
    resample of the units."""
    sums = _column_sums(_unpivoted(rows, unit, [a, b], target), n, seed, per_range)
    area = lambda c: F.max(F.when(F.col("_column") == c, F.col("roc_auc")))
    return _roc(sums, ["_column"]).groupBy("replicate").agg((area(a) - area(b)).alias("delta"))


def _unpivoted(rows: DataFrame, unit: str, columns: list[str], target: str | None) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns])
    whole = rows.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`)" for c in columns))
    return whole.select(F.xxhash64(unit).alias("_unit"), (F.col(target) if target else F.lit(0)).cast("int").alias("_target"), F.inline(pairs))


def _column_sums(long: DataFrame, n: int, seed: int, per_range: int) -> DataFrame:
    """_column, _cut, replicate, p, n, area of the columns' ranges."""
    ranged = _ranged(long, ["_column"], "_value", per_range)
    run = _runs(ranged, ["_column"], n)
    dealt, task = _in_tasks(_blocks(ranged, n, run), ["_column", "_cut", "_block"])

    def of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_value")
        units, values, y = part["_unit"].to_numpy(), part["_value"].to_numpy(), part["_target"].to_numpy() == 1
        # What of the negatives is below a positive, and what below or equal.
        low, high = (np.searchsorted(values[~y], values[y], side) for side in ("left", "right"))
        ahead, behind, rows = units[y], units[~y], []
        for b in _of_block(int(part["_block"].iloc[0]), n, run):
            pos, neg = unit_counts(ahead, b, seed), _up_to(unit_counts(behind, b, seed))
            rows.append((part["_column"].iloc[0], int(part["_cut"].iloc[0]), b, float(pos.sum(dtype=np.int64)), float(neg[-1]), float(np.dot(pos.astype(float), (neg[low] + neg[high]) / 2))))
        return pd.DataFrame(rows, columns=["_column", "_cut", "replicate", "p", "n", "area"])

    return cut_lineage(dealt.groupBy(*task).applyInPandas(of, "_column string, _cut bigint, replicate int, p double, n double, area double"), "resampled")


MOMENTS = ("w", "x", "y", "xx", "yy", "xy")


def spearman_bootstrap(rows: DataFrame, unit: str, a: str, b: str, n: int = 2000, seed: int = 42, per_range: int = 2_000_000) -> DataFrame:
    """replicate, rho: the rank correlation of ``a`` and ``b`` in resamples of
    the units.

    The units lie in a grid of ranges of ``a`` by ranges of ``b``. A cell's
    task has the units of its row and of its column, draws their counts and so
    knows its own units' ranks within the row and the column. Only the counts'
    and ranks' moments leave it, a row a cell and replicate; the weights of the
    ranges before are added to ranks afterwards, as a shift of moments. A unit
    goes to as many cells as there are ranges, whatever the replicates; up to
    ``per_range`` units are a grid of one cell."""
    clean = rows.where(present(F.col(a)) & present(F.col(b)))
    base = clean.select(F.xxhash64(unit).alias("_unit"), F.col(a).cast("double").alias("_x"), F.col(b).cast("double").alias("_y"), F.lit(0).alias("_k"))
    grid = _ranged(base, ["_k"], "_x", per_range).withColumnRenamed("_cut", "_cx")
    grid = _ranged(grid, ["_k"], "_y", per_range).withColumnRenamed("_cut", "_cy")
    last = grid.agg(F.max("_cx").alias("x"), F.max("_cy").alias("y")).first()
    if last["x"] is None:
        return rows.sparkSession.createDataFrame([], "replicate int, rho double")
    run = _runs(grid.select(F.col("_cx").alias("_cut"), "_cy"), ["_cy"], n)
    every = lambda name, end: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(end).cast("long"))).alias(name)
    in_row = grid.select("_unit", "_x", "_y", F.col("_cx").alias("_r"), every("_q", last["y"]), "_cy").select("*", F.lit(True).alias("_row"), (F.col("_q") == F.col("_cy")).alias("_column"))
    in_column = grid.select("_unit", "_x", "_y", every("_r", last["x"]), F.col("_cy").alias("_q"), "_cx").where("_r <> _cx").select("*", F.lit(False).alias("_row"), F.lit(True).alias("_column"))
    dealt, task = _in_tasks(_blocks(in_row.drop("_cy").unionByName(in_column.drop("_cx")), n, run), ["_r", "_q", "_block"])
    schema = "_r bigint, _q bigint, replicate int, row double, column double, " + ", ".join(f"{m} double" for m in MOMENTS)

    def within(values: np.ndarray, member: np.ndarray, own: np.ndarray):
        """The members in their values' order, where in it each different
        value begins and ends, and which of these the own units have."""
        order = np.flatnonzero(member)[np.argsort(values[member], kind="stable")]
        different, begins = np.unique(values[order], return_index=True)
        return order.astype(np.int32), np.append(begins, len(order)).astype(np.int32), np.searchsorted(different, values[own]).astype(np.int32)

    def cell(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_x")
        units, row, column = part["_unit"].to_numpy(), part["_row"].to_numpy(), part["_column"].to_numpy()
        xs, ys, own, out = part["_x"].to_numpy(), part["_y"].to_numpy(), np.flatnonzero(row & column), []
        (in_x, x_ends, x_of), (in_y, y_ends, y_of) = within(xs, row, own), within(ys, column, own)
        for r in _of_block(int(part["_block"].iloc[0]), n, run):
            w = unit_counts(units, r, seed)
            to_x, to_y = _up_to(w[in_x])[x_ends], _up_to(w[in_y])[y_ends]
            rank_x, rank_y, sums = (to_x[1:] + to_x[:-1]) / 2, (to_y[1:] + to_y[:-1]) / 2, np.zeros(len(MOMENTS))
            for i in range(0, len(own), CHUNK):
                at = slice(i, i + CHUNK)
                v, x, y = w[own[at]].astype(float), rank_x[x_of[at]], rank_y[y_of[at]]
                vx, vy = v * x, v * y
                sums += (v.sum(), vx.sum(), vy.sum(), vx @ x, vy @ y, vx @ y)
            out.append((part["_r"].iloc[0], part["_q"].iloc[0], r, to_x[-1], to_y[-1], *sums))
        return pd.DataFrame(out, columns=["_r", "_q", "replicate", "row", "column", *MOMENTS])

    cells = cut_lineage(dealt.groupBy(*task).applyInPandas(cell, schema), "cells")
    before = lambda at: Window.partitionBy("replicate").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    ranges = lambda at, of, name: cells.groupBy("replicate", at).agg(F.max(of).alias("_w")).select("replicate", at, F.coalesce(F.sum("_w").over(before(at)), F.lit(0.0)).alias(name))
    met = cells.join(ranges("_r", "row", "ox"), ["replicate", "_r"]).join(ranges("_q", "column", "oy"), ["replicate", "_q"])
    w, x, y, ox, oy = (F.col(c) for c in ("w", "x", "y", "ox", "oy"))
    shifted = {"w": w, "x": x + ox * w, "y": y + oy * w, "xx": F.col("xx") + 2 * ox * x + ox * ox * w, "yy": F.col("yy") + 2 * oy * y + oy * oy * w, "xy": F.col("xy") + ox * y + oy * x + ox * oy * w}
    m = met.groupBy("replicate").agg(*[F.sum(v).alias(c) for c, v in shifted.items()])
    spread = lambda u, v, uv: F.col("w") * F.col(uv) - F.col(u) * F.col(v)
    return m.select("replicate", F.try_divide(spread("x", "y", "xy"), F.sqrt(spread("x", "x", "xx") * spread("y", "y", "yy"))).alias("rho"))


def percentile_interval(replicates: DataFrame, value: str, name: Callable[[str], str] = lambda e: e) -> DataFrame:
    """One row: the 2.5 and 97.5 percentiles of a replicate's value, the share
    above 0 and the number of replicates that have one."""
    v = F.col(value)
    return replicates.where(v.isNotNull() & ~F.isnan(v)).agg(F.percentile(v, 0.025).alias(name("lo")), F.percentile(v, 0.975).alias(name("hi")), F.avg((v > 0).cast("int")).alias("p_positive"), F.count("*").alias("n"))
