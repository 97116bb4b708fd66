"""A uniform shuffle into shards of exact sizes.

The number of rows that input partition p sends to shard s, over all p and s,
is a random matrix with fixed row sums (the partitions' sizes) and column sums
(the shards' sizes): under a uniform shuffle a multivariate hypergeometric
one. A task draws its own row of it: halving the range of partitions again and
again, it draws how many rows of each shard fall into the left half, from a
generator seeded by the range, so that all tasks agree without anybody holding
the matrix. Then the task deals its rows out by a permutation of these counts,
the whole rows are exchanged, and each receiver permutes what it got. A receiver
gets a block of ``block_rows`` places of a shard at most, and of no more places
than rows of mean size fill ``block_bytes``, so shards of any size are spread
over many tasks; a block is a column of the matrix. Partitions of more than
2**20 rows count as several.

Draws are exact at any size: numpy's below 10**9 rows, and the same rejection
(Stadlober's ratio of uniforms) with log factorials to 40 digits from there on.

Rows are dealt and settled batch by batch: a task holds a number for each row
of a part or block, and never the rows of one. How a block's size in bytes
falls out is thus no matter of memory. What tasks are sent is a number for each
part; blocks are worked out from the number of rows.

Row identities come from a copy of the rows written to the shared folder, so
that retried tasks deal the same rows alike.

Law `rows`: shards' counts differ by one at most, larger ones first.

Defined cases: every row, with nulls or repeated, is a row of its own; texts
may be of any length, as a row goes through whole; an empty table gives an
empty one; the result has the columns of the input and ``shard`` and ``slot``
(0 to the shard's size - 1), names that the input must not have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, MapType, StringType, StructField, StructType

from brindle.llm.store import materialize

#: Rows from which numpy does not draw.
EXACT = 10**9
# The method's constants, 2 * sqrt(2 / e) and 3 - 2 * sqrt(3 / e),
# and half the logarithm of 2 * pi.
D1, D2 = 1.7155277699214135, 0.8989161620588988
HALF_LN_2_PI = Decimal("0.918938533204672741780329736405617639861397473637783412817")
#: Rows of a part, as a power of two.
PART_BITS = 20


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def cells(rows: int, shards: int, block_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, size) of the blocks, even within a shard."""
    sizes = np.array(shard_sizes(rows, shards), np.int64)
    blocks = np.maximum(1, -(-sizes // block_rows))
    shard = np.repeat(np.arange(shards, dtype=np.int64), blocks)
    k = np.arange(len(shard)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    each, more = (sizes // blocks)[shard], (sizes % blocks)[shard]
    return shard, k * each + np.minimum(k, more), each + (k < more)


def _log_factorial(n: int) -> Decimal:
    """ln n! to some 40 digits; Stirling's series from 1,000 on."""
    if n < 1000:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7) + 1 / (1188 * x**9) - Decimal(691) / (360360 * x**11)
    return (x + Decimal("0.5")) * x.ln() - x + HALF_LN_2_PI + series


def large_draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones there are among ``n`` drawn without return. Exact
    for any numbers (Stadlober, "The ratio of uniforms approach for generating
    discrete random variates", 1990)."""
    total, few, many, m = good + bad, min(good, bad), max(good, bad), min(n, good + bad - n)
    if few == 0 or m == 0:
        k = 0
    elif m <= 16:  # one by one
        k, left = 0, few
        for drawn in range(m):
            hit = int(rng.integers(total - drawn)) < left
            k, left = k + hit, left - hit
    else:
        with localcontext() as digits:
            digits.prec = 45
            weight = lambda z: _log_factorial(z) + _log_factorial(few - z) + _log_factorial(m - z) + _log_factorial(many - m + z)
            mean = m * few / total
            width = D1 * math.sqrt((total - m) * m * (few / total) * (many / total) / (total - 1) + 0.5) + D2
            mode = (m + 1) * (few + 1) // (total + 2)
            top = weight(mode)
            while True:
                u, v = 1.0 - rng.random(), rng.random()
                at = mean + 0.5 + width * (v - 0.5) / u
                if not 0 <= at < min(m, few) + 1:
                    continue
                k = math.floor(at)
                if 2 * Decimal(u).ln() <= top - weight(k):
                    break
    k = m - k if good > bad else k
    return good - k if m < n else k


def _one(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    return int(rng.hypergeometric(good, bad, n)) if good + bad < EXACT else large_draw(rng, good, bad, n)


def draw(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows drawn without return fall to each size."""
    if len(sizes) == 1:
        return np.array([n], np.int64)
    total = int(sizes.sum())
    if total < EXACT:
        return rng.multivariate_hypergeometric(sizes, n, method="marginals")
    half = len(sizes) // 2
    first = int(sizes[:half].sum())
    left = _one(rng, first, total - first, n)
    return np.concatenate([draw(rng, sizes[:half], left), draw(rng, sizes[half:], n - left)])


def matrix_row(place: int, ends: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """Row ``place`` of the matrix. ends: cumulative sizes of the partitions,
    from 0."""
    lo, hi, left = 0, len(ends) - 1, sizes.astype(np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        first = draw(np.random.default_rng([seed, lo, hi]), left, int(ends[mid] - ends[lo]))
        if place < mid:
            hi, left = mid, first
        else:
            lo, left = mid, left - first
    return left


def _row_bytes(schema: StructType) -> Column:
    """About the bytes of a row."""
    total = F.lit(0).cast("long")
    for f in schema.fields:
        if isinstance(f.dataType, (StringType, BinaryType)):
            total = total + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            total = total + F.coalesce(F.octet_length(F.to_json(f.name)), F.lit(0))
        else:
            total = total + 16
    return total


def shard_rows(rows: DataFrame, shards: int, seed: int = 20240229, block_rows: int = 1 << 20, block_bytes: int = 1 << 25) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``, uniformly at random."""
    if shards < 1 or {"shard", "slot"} & set(rows.columns):
        raise ValueError("one shard at least, and no columns named shard or slot")
    names = rows.columns
    kept = rows.toDF(*[f"c{k}" for k in range(len(names))])
    own_fields = kept.schema
    kept = materialize(kept.withColumn("rid", F.monotonically_increasing_id()), "rows")
    # Ids count on from 0 within a partition, so a part's are without gaps.
    counts = kept.groupBy(F.shiftright("rid", PART_BITS).alias("part")).agg(F.count("*").alias("n"), F.sum(_row_bytes(own_fields)).alias("bytes")).orderBy("part").collect()  # one a part
    parts = np.array([r["part"] for r in counts], np.int64)
    ends = np.concatenate([[0], np.cumsum([r["n"] for r in counts])]).astype(np.int64)
    total, n_bytes = int(ends[-1]), sum(r["bytes"] for r in counts)
    fitting = max(1, block_bytes * total // n_bytes) if n_bytes else block_rows
    block_rows = min(block_rows, fitting)

    def dealt_cells(part: int, sizes: np.ndarray) -> np.ndarray:
        row = matrix_row(int(np.searchsorted(parts, part)), ends, sizes, seed)
        return np.random.default_rng([seed, 1, part]).permutation(np.repeat(np.arange(len(sizes), dtype=np.int32), row))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, np.empty(0, np.int32)
        sizes = cells(total, shards, block_rows)[2]
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            of, cell = rid >> PART_BITS, np.empty(len(rid), np.int32)
            for part in np.unique(of).tolist():
                if part != now:
                    now, held = part, dealt_cells(part, sizes)
                own = of == part
                cell[own] = held[rid[own] & ((1 << PART_BITS) - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, held = -1, 0, np.empty(0, np.int64)
        of, first, sizes = cells(total, shards, block_rows)
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            slot = np.empty(len(cell), np.int64)
            cuts = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if cell[lo] != now:
                    now, at = int(cell[lo]), 0
                    held = first[now] + np.random.default_rng([seed, 2, now]).permutation(sizes[now])
                slot[lo:hi] = held[at : at + hi - lo]
                at += hi - lo
            shard = of[cell].astype(np.int32)
            kept_columns = [n for n in batch.schema.names if n not in ("rid", "cell")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept_columns], pa.array(shard), pa.array(slot)], names=[*kept_columns, "shard", "slot"])

    dealt = kept.mapInArrow(deal, StructType([*own_fields.fields, StructField("rid", LongType()), StructField("cell", IntegerType())]))
    met = dealt.repartition("cell").sortWithinPartitions("cell", "rid")
    out = met.mapInArrow(settle, StructType([*own_fields.fields, StructField("shard", IntegerType()), StructField("slot", LongType())]))
    return out.toDF(*names, "shard", "slot")


def write_shards(sharded: DataFrame, path: str, file_rows: int = 1 << 20) -> None:
    """A folder for each shard, with files of ``file_rows`` slots at most, each
    sorted by slot; a task gets files and not shards, so a shard may be large."""
    file = F.floor(F.col("slot") / file_rows)
    sharded.repartition("shard", file).sortWithinPartitions("shard", "slot").write.option("maxRecordsPerFile", file_rows).partitionBy("shard").parquet(path)
