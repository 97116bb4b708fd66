"""Near-duplicates by SimHash and a self-join over binary tries.

Equal fingerprints are one trie leaf, so the join runs over distinct
fingerprints. It traverses pairs of trie nodes together, from the pair of the
root with itself: a pair splits into the pairs of its children, the error count
grows by one where the children's bits differ, and a pair goes as soon as its
errors exceed the budget or one of its nodes is empty.

The first ``step`` levels, and further ones for every node pair that still has
more than ``max_node`` fingerprints, are walked by DataFrame operations: a row
is a fingerprint's place in a node pair with the errors so far, and a row
becomes those of the pair's descendants that its fingerprint is in. Node pairs
with few fingerprints then go to tasks, which walk all of theirs down level by
level, as arrays; a pair of at most ``leaf`` combinations is compared outright.
A fingerprint has C(d, 0) + C(d, 1) + C(d, 2) places at depth d with a budget
of two, so rows grow with the fingerprints and the square of the depth, not
with the size of a group.

A task returns a star for each group that it links and not all pairs, so the
number of edges is linear in the number of places; stars meet in
``components``.

Defined cases: a null or empty text has fingerprint zero and links like any
other; a null doc_id takes part but is never a component's name, unless a
component has no other, whose name is then null; repeated rows count as
copies; a text of any length is hashed whole, in one worker's memory; an empty
table gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.components import components
from brindle.llm.memory import give_back
from brindle.llm.store import materialize

SEED = 42
KEY = ("depth", "a", "b")


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text's word shingles, as an unsigned integer."""
    import xxhash

    words = (text or "").encode().lower().split()  # both for ASCII only
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)), strict=False)]
    # How often each byte value stands at each of the 8 places, then bits.
    octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
    octets += np.arange(0, 2048, 256)
    found = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256)
    bits = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1
    return int.from_bytes(np.packbits((found @ bits * 2 > len(hashes)).ravel()).tobytes(), "big")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the fingerprints as signed longs."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])
        give_back()

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(of, f"id {kind}, fp bigint")


def trie_pairs(fps: np.ndarray, starts: np.ndarray, middles: np.ndarray, ends: np.ndarray, budget: int, leaf: int = 16, slice_pairs: int = 1 << 18, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of the linked fingerprints of many tries at once, in
    parts. fps has a row of 64-bit words for each fingerprint.

    Trie t holds the fingerprints from starts[t] to ends[t]. Up to middles[t]
    they are its left side and from there on its right one, each sorted; only
    pairs across are asked for. With middles[t] = ends[t], all pairs within.

    All node pairs of a level go down together; where they are more than
    ``most``, in parts that are walked to the end one after another.
    """
    bits = 64 * fps.shape[1]
    inner = middles == ends
    first = (starts, middles, np.where(inner, starts, middles), ends, np.zeros(len(starts), np.int64))
    stack = [(0, first)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs[0]) > most:
            stack += [(depth, tuple(x[at : at + most] for x in pairs)) for at in range(0, len(pairs[0]), most)]
            continue
        al, ah, bl, bh, errors = pairs
        na, nb = ah - al, bh - bl
        done = (na * nb <= leaf) if depth < bits else np.ones(len(al), bool)
        if done.any():  # leaf buckets: compare outright
            yield from _leaves(fps, al[done], na[done], bl[done], nb[done], budget, slice_pairs)
        if done.all():
            continue
        go = ~done
        al, ah, bl, bh, errors = al[go], ah[go], bl[go], bh[go], errors[go]
        bit = (fps[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit).astype(np.int64)])
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        every, own = np.ones(len(al), bool), al == bl
        parts = [(al, am, bl, bm, errors, every), (am, ah, bm, bh, errors, every), (al, am, bm, bh, errors + 1, every), (am, ah, bl, bm, errors + 1, ~own)]
        al, ah, bl, bh, errors, use = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = use & (ah > al) & (bh > bl) & (errors <= budget) & ~((al == bl) & (ah - al == 1))
        stack.append((depth + 1, (al[live], ah[live], bl[live], bh[live], errors[live])))


def _leaves(fps: np.ndarray, al: np.ndarray, na: np.ndarray, bl: np.ndarray, nb: np.ndarray, budget: int, slice_pairs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The linked pairs of leaf buckets, ``slice_pairs`` or so at a time."""
    ends = np.cumsum(na * nb)
    at = 0
    while at < len(al):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + slice_pairs, "right")))
        sizes = (na * nb)[at:stop]
        k = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        wide = np.repeat(nb[at:stop], sizes)
        i, j = np.repeat(al[at:stop], sizes) + k // wide, np.repeat(bl[at:stop], sizes) + k % wide
        keep = ~np.repeat((al == bl)[at:stop], sizes) | (i < j)
        i, j = i[keep], j[keep]
        differ = np.zeros(len(i), np.int64)
        for word in range(fps.shape[1]):  # go on with pairs within the budget only
            differ = differ + np.bitwise_count(fps[i, word] ^ fps[j, word])
            near = differ <= budget
            i, j, differ = i[near], j[near], differ[near]
        if len(i):
            yield i, j
        at = stop


class Groups:
    """Union of linked positions; a group's label is its least position."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Fingerprints (a long, or 64-bit big-endian words) as rows of words."""
    column = column.combine_chunks()
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64).reshape(-1, 1)
    return np.array(column.to_pylist()).view(">u8").reshape(len(column), -1).astype(np.uint64)


def _join_tries(budget: int, key: tuple[str, ...] = KEY, fp_column: str = "fp", node_column: str = "fp", leaf: int = 16):
    """mapInArrow body over rows sorted by ``key``: stars of the links within
    each node pair."""

    def solve(side: np.ndarray, fps: np.ndarray, node: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        order = np.lexsort((*(fps[:, w] for w in range(fps.shape[1] - 1, -1, -1)), side, group))
        side, fps, node = side[order], fps[order], node[order]
        starts, ends = cuts[:-1], cuts[1:]
        rights = np.concatenate([[0], np.cumsum(side)])
        n_right = rights[ends] - rights[starts]
        groups = Groups(len(node))
        for i, j in trie_pairs(fps, starts, ends - n_right, ends, budget, leaf):
            groups.add(i, j)
        member = np.flatnonzero(groups.label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[member]), pa.array(node[groups.label[member]])], names=["u", "v"])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def split(table: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
            n = table.num_rows
            keys = [table.column(k).to_numpy() for k in key]
            change = np.zeros(max(n - 1, 0), bool)
            for k in keys:
                change |= k[1:] != k[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1, [n]]) if n else np.zeros(1, np.int64)
            whole = len(cuts) - 1 if last else len(cuts) - 2
            if whole < 1:
                return None, table
            end = cuts[whole]
            part = table.slice(0, end)
            out = solve(part.column("side").to_numpy(), _words(part.column(fp_column)), part.column(node_column).to_numpy(), cuts[: whole + 1])
            return out, None if last else table.slice(end)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            if held.num_rows >= 200_000:
                out, held = split(held, False)
                if out is not None:
                    yield out
        if held is not None and held.num_rows:
            out, held = split(held, True)
            yield out
        give_back()

    return of


def _descend(rows: DataFrame, step: int, budget: int) -> DataFrame:
    """Rows of node pairs as rows of their descendants' pairs, ``step`` levels
    further down, without those beyond the budget."""
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << step) if m.bit_count() <= budget])
    child = F.expr(f"shiftrightunsigned(fp, cast(64 - depth - {step} as int)) & {(1 << step) - 1}L")
    open_ = rows.withColumn("c", child).withColumn("m", F.explode(masks)).withColumn("errors", F.col("errors") + F.bit_count("m")).where(F.col("errors") <= budget)
    other, own = F.col("c").bitwiseXOR(F.col("m")), F.col("a") == F.col("b")
    a_bits = F.when(own, F.least("c", other)).when(F.col("side") == 0, F.col("c")).otherwise(other)
    b_bits = F.when(own, F.greatest("c", other)).when(F.col("side") == 0, other).otherwise(F.col("c"))
    side = F.when(own, (other < F.col("c")).cast("long")).otherwise(F.col("side"))
    return open_.select(
        (F.col("depth") + step).alias("depth"),
        F.shiftleft("a", step).bitwiseOR(a_bits).alias("a"),
        F.shiftleft("b", step).bitwiseOR(b_bits).alias("b"),
        "errors",
        side.alias("side"),
        "fp",
    )


def links(fps: DataFrame, budget: int = 2, max_node: int = 10_000, step: int = 6) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fps`` (fp) within
    ``budget`` differing bits. ``max_node`` and ``step`` decide where a pair is
    walked and not what is found."""
    zero = F.lit(0).cast("long")
    root = fps.select(F.lit(0).alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(0).alias("errors"), zero.alias("side"), "fp")
    rows, ready = materialize(_descend(root, step, budget), "nodes"), []
    while True:
        nodes = rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.sum("side").alias("n_right"))
        live = nodes.where(F.when(F.col("a") == F.col("b"), F.col("n") >= 2).otherwise((F.col("n_right") >= 1) & (F.col("n_right") < F.col("n"))))
        hot = materialize(live.where((F.col("n") > max_node) & (F.col("depth") + step <= 64)).select(*KEY), "hot")
        if hot.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(live.where((F.col("n") <= max_node) | (F.col("depth") + step > 64)).select(*KEY), list(KEY), "left_semi"))
        rows = materialize(_descend(rows.join(hot, list(KEY), "left_semi"), step, budget), "nodes")
    found = ready[0]
    for more in ready[1:]:
        found = found.unionByName(more)
    dealt = found.select(*KEY, "side", "fp").repartition(*KEY).sortWithinPartitions(*KEY)
    return dealt.mapInArrow(_join_tries(budget), "u bigint, v bigint")


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 3, budget: int = 2, max_node: int = 10_000) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``."""
    each = materialize(fingerprints(docs, id_column, text_column, width), "fingerprints")
    distinct = materialize(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), budget, max_node))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = rooted.join(names, "root").select("fp", "component_id")
    return each.join(named, "fp").select("id", "fp", "component_id")


#: Constants that turn a shingle's hash into further independent ones.
WIDE_WORDS, ANCHORS = 8, 6
GAMMA = 0x9E3779B97F4A7C15


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash function number k of the hashes (SplitMix64's finalizer)."""
    x = hashes + np.uint64((k + 1) * GAMMA & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted; a text with fewer
    words than ``width`` is one shingle, one without words has none."""
    import xxhash

    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.array([digest(b" ".join(s), SEED) for s in zip(*(words[i:] for i in range(width)), strict=False)], np.uint64))


def wide_sketch(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """The 512-bit SimHash of distinct shingle hashes and their anchors, the
    least values of six hash functions over them."""
    if not len(hashes):
        return bytes(8 * WIDE_WORDS), [0] * ANCHORS
    octets = np.stack([_mixed(hashes, k) for k in range(WIDE_WORDS)], 1).astype(">u8").view(np.uint8).astype(np.int64)
    octets += np.arange(0, 256 * 8 * WIDE_WORDS, 256)
    found = np.bincount(octets.ravel(), minlength=256 * 8 * WIDE_WORDS).reshape(-1, 256)
    bits = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1
    anchors = [int(_mixed(hashes, WIDE_WORDS + k).min().view(np.int64)) for k in range(ANCHORS)]
    return np.packbits((found @ bits * 2 > len(hashes)).ravel()).tobytes(), anchors


def wide_links(nodes: DataFrame, budget: int, max_node: int = 2048) -> DataFrame:
    """Edges (u, v) between ``nodes`` (node, fp, anchors) that share an anchor
    and differ in ``budget`` bits at most. An anchor's nodes are a trie; one
    with more than ``max_node`` is dealt out in pairs of blocks of them, each
    pair a task's node pair, so that size changes nothing about the result."""
    rows = nodes.select("node", "fp", F.posexplode("anchors").alias("i", "anchor")).select(F.xxhash64("i", "anchor").alias("key"), "node", "fp")
    hot = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > max_node).select("key", F.ceil(F.col("n") / max_node).cast("int").alias("blocks")), "hot-anchors")
    plain = rows.select("key", F.lit(0).cast("long").alias("side"), "node", "fp")
    if hot.isEmpty():
        found = plain
    else:
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        split = rows.join(hot, "key").withColumn("own", own).select("key", "node", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
        pairs = split.select(F.xxhash64("key", F.least("own", "b"), F.greatest("own", "b")).alias("key"), (F.col("own") > F.col("b")).cast("long").alias("side"), "node", "fp")
        found = plain.join(hot, "key", "left_anti").unionByName(pairs)
    dealt = found.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_join_tries(budget, ("key",), "fp", "node"), "u bigint, v bigint")


class Overlaps:
    """Sets of distinct values, and how many a set shares with each other."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        self.owners = np.repeat(np.arange(len(sets)), self.sizes)[np.argsort(self.codes, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.codes))])
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)])

    def shared(self, i: int) -> np.ndarray:
        own = self.codes[self.firsts[i] : self.firsts[i + 1]]
        low, many = self.starts[own], self.starts[own + 1] - self.starts[own]
        k = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        return np.bincount(self.owners[k], minlength=len(self.sizes))

    def linked(self, shared: np.ndarray, i: int) -> np.ndarray:
        """Whether the similarity to set i is 0.8 or more."""
        return 9 * shared >= 4 * (self.sizes + self.sizes[i])

    def apart(self, shared: np.ndarray, i: int) -> np.ndarray:
        """1 - Jaccard similarity to set i, which is a metric."""
        union = self.sizes + self.sizes[i] - shared
        return 1 - np.divide(shared, union, out=np.ones(len(shared)), where=union > 0)


def similar(sets: list[np.ndarray], overlaps: Overlaps | None = None) -> np.ndarray:
    """For each set of distinct values, the least position in its class, where
    sets of a Jaccard similarity of 0.8 or more are linked. Exact: every pair
    is counted that is not in one class yet and whose sizes allow it."""
    groups, over = Groups(len(sets)), overlaps or Overlaps(sets)
    sizes, after = over.sizes, np.arange(len(sets))
    for i in range(len(sets) - 1):
        ask = (after > i) & (groups.label != groups.label[i]) & (5 * np.minimum(sizes, sizes[i]) >= 4 * np.maximum(sizes, sizes[i]))
        if ask.any():
            near = np.flatnonzero(ask & over.linked(over.shared(i), i))
            groups.add(np.full(len(near), i), near)
    return groups.label


def _by_key(width: int, kinds: dict[str, pa.DataType], solve):
    """mapInArrow body over (key, node, text, extra) rows sorted by key:
    ``solve`` gets a key's nodes, sets and extras and gives rows of ``kinds``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, sets, extras, found = None, [], [], [], []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds.values())], names=list(kinds))

        for batch in batches:
            keys, own, texts, more = batch.columns
            for key, node, text, extra in zip(keys.to_pylist(), own.to_pylist(), texts, more.to_pylist(), strict=True):
                if key != now:
                    found += solve(nodes, sets, extras) if nodes else []
                    now, nodes, sets, extras = key, [], [], []
                nodes.append(node)
                sets.append(shingle_hashes(text.as_py(), width))
                extras.append(extra)
            yield told()
            found = []
        found += solve(nodes, sets, extras) if nodes else []
        yield told()
        give_back()

    return of


VERIFIED = {"u": pa.int64(), "v": pa.int64(), "radius": pa.float64()}
COMPARED = {"u": pa.int64(), "v": pa.int64(), "open": pa.bool_()}


def _classes_of_block(nodes: list, sets: list, large: list) -> list[tuple]:
    """(u, v, null) stars of a block's classes; of a part of a larger class
    also (v, v, radius): each class's least node and how far the others are."""
    if len(nodes) == 1:
        return [(nodes[0], nodes[0], 0.0)] if large[0] else []
    over = Overlaps(sets)
    label = similar(sets, over)
    rows = [(nodes[i], nodes[j], None) for i, j in enumerate(label.tolist()) if i != j]
    for j in np.unique(label).tolist() if large[0] else []:
        own = np.flatnonzero(label == j)
        rows.append((nodes[j], nodes[j], float(over.apart(over.shared(j), j)[own].max()) if len(own) > 1 else 0.0))
    return rows


def _compared(nodes: list, sets: list, radius: list) -> list[tuple]:
    """(u, v, open) of classes' least nodes: links of 0.8 between them, and
    open pairs whose other members may be as similar, by the triangle
    inequality, and which the links do not connect."""
    if len(nodes) == 1:
        return []
    over, groups, r, after = Overlaps(sets), Groups(len(sets)), np.array(radius), np.arange(len(sets))
    maybe, rows = [], []
    for i in range(len(sets) - 1):
        shared = over.shared(i)
        near = (after > i) & over.linked(shared, i)
        groups.add(np.full(int(near.sum()), i), np.flatnonzero(near))
        open_ = (after > i) & ~near & (r + r[i] > 0) & (over.apart(shared, i) <= 0.2 + r + r[i] + 1e-9)
        maybe += [(i, j) for j in np.flatnonzero(open_).tolist()]
    rows = [(nodes[i], nodes[j], False) for i, j in enumerate(groups.label.tolist()) if i != j]
    return rows + [(nodes[i], nodes[j], True) for i, j in maybe if groups.label[i] != groups.label[j]]


def _dealt(rows: DataFrame, width: int, kinds: dict[str, pa.DataType], solve) -> DataFrame:
    schema = ", ".join(f"{n} {'bigint' if t == pa.int64() else 'double' if t == pa.float64() else 'boolean'}" for n, t in kinds.items())
    return rows.select("key", "node", "text", "extra").repartition("key").sortWithinPartitions("key").mapInArrow(_by_key(width, kinds, solve), schema)


def _in_blocks(rows: DataFrame, max_members: int, block_bytes: int) -> DataFrame:
    """root, blocks: in how many parts each class of ``rows`` is dealt."""
    sized = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / max_members), F.ceil(F.col("bytes") / block_bytes), F.lit(1)).cast("int")
    return sized.select("root", F.least(blocks, F.col("n").cast("int")).alias("blocks")).where("blocks > 1")


def _in_pairs(rows: DataFrame, max_members: int, block_bytes: int) -> DataFrame:
    """``rows`` (root, node, text, extra) with the key of the task that has
    their class, or of each pair of blocks that theirs is in."""
    parts = materialize(_in_blocks(rows, max_members, block_bytes), "parts")
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int")
    split = rows.join(parts, "root", "left").withColumn("own", own).withColumn("b", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return split.where("blocks is null or own <> b").select(F.xxhash64("root", F.least("own", "b"), F.greatest("own", "b")).alias("key"), "node", "text", "extra")


def similar_links(texts: DataFrame, width: int, max_members: int = 1024, block_bytes: int = 1 << 22) -> DataFrame:
    """Edges (u, v) that connect those ``texts`` (root, node, text) of a
    candidate class ``root`` that are 0.8 similar. A class is a task's work.

    One of more than ``max_members`` texts or ``block_bytes`` is dealt out in
    blocks, no text twice. Each block finds its own classes; then only their
    least members meet. Where two of those are not similar, but so near that
    other members might be, by the triangle inequality, all members of the
    classes concerned meet, in pairs of blocks; so no link is lost. A large
    group of copies that are all near each other is a class a block and costs
    no pairs of blocks; in a looser one a text is read once for each block."""
    large = materialize(_in_blocks(texts, max_members, block_bytes), "large-classes")
    own = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1)))
    first = texts.join(large, "root", "left").select(F.xxhash64("root", own).alias("key"), "node", "text", F.col("blocks").isNotNull().alias("extra"))
    verified = materialize(_dealt(first, width, VERIFIED, _classes_of_block), "verified")
    edges = verified.where("radius is null").select("u", "v")
    if large.isEmpty():
        return edges
    reps = materialize(verified.where("radius is not null").select(F.col("v").alias("node"), F.col("radius").alias("extra")).join(texts, "node"), "least-members")
    compared = materialize(_dealt(_in_pairs(reps, max_members, block_bytes), width, COMPARED, _compared), "compared")
    known = materialize(edges.unionByName(compared.where("not open").select("u", "v")), "links")
    doubt = compared.where("open").select("u", "v").distinct()
    if doubt.isEmpty():
        return known
    rooted = components(known)
    at = lambda side: rooted.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    apart = doubt.join(at("u"), "u", "left").join(at("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")).where("u <> v")
    met = materialize(components(apart), "doubts")
    met = met.unionByName(met.select(F.col("root").alias("node"), "root").distinct())
    members = rooted.unionByName(rooted.select(F.col("root").alias("node"), "root").distinct()).select("node", F.col("root").alias("of"))
    every = texts.select("node").join(members, "node", "left").select("node", F.coalesce("of", "node").alias("of"))
    full = every.join(met.select(F.col("node").alias("of"), "root"), "of").select("root", "node").join(texts.select("node", "text"), "node").withColumn("extra", F.lit(False))
    full = materialize(full, "in-doubt")
    return known.unionByName(_dealt(_in_pairs(full, max_members, block_bytes), width, VERIFIED, _classes_of_block).select("u", "v"))


def _classes(docs: DataFrame, id_column: str, text_column: str, width: int, budget: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of rows (rid, row), of their identities (rid, id, identity) and
    of the classes of those (identity, component_id, keep): see
    ``near_classes``. ``row`` has all columns; ``keep`` is the number of the
    class's first row by identifier, identity and place, rows without an
    identifier last."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            made, identities = [], []
            for t in batch.column(2):
                hashes = shingle_hashes(t.as_py(), width)
                fp, anchors = wide_sketch(hashes)
                words = (t.as_py() or "").encode().lower().split()
                # A single shingle is its text's identity: such texts are equal or apart.
                identities.append(xxhash.xxh3_128_digest(b" ".join(words[:width] if len(hashes) < 2 else words)))
                made.append((fp, anchors if len(hashes) > 1 else []))
            columns = [pa.array(identities, pa.binary()), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["rid", "id", "identity", "fp", "anchors"])
        give_back()

    kind = docs.schema[id_column].dataType.simpleString()
    rows = materialize(docs.select(F.struct("*").alias("row")).withColumn("rid", F.monotonically_increasing_id()), "rows")
    id_, text = F.col("row").getField(id_column).alias("id"), F.col("row").getField(text_column).alias("text")
    each = materialize(rows.select("rid", id_, text).mapInArrow(of, f"rid bigint, id {kind}, identity binary, fp binary, anchors array<bigint>"), "wide")
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "identity", "rid"))
    distinct = materialize(each.groupBy("identity").agg(F.min("fp").alias("fp"), F.min("anchors").alias("anchors"), first.alias("first"), F.min("rid").alias("node")), "wide-distinct")
    maybe = components(wide_links(distinct, budget))
    members = maybe.unionByName(maybe.select(F.col("root").alias("node"), "root").distinct())
    # One plan at every size: an automatic broadcast would stop at some size.
    texts = members.hint("merge").join(rows.select(F.col("rid").alias("node"), text), "node").select("root", "node", "text")
    roots = components(similar_links(materialize(texts, "candidates"), width))
    rooted = distinct.join(roots, "node", "left").select("identity", "first", F.coalesce("root", "node").alias("root"))
    names = materialize(rooted.groupBy("root").agg(F.min("first").alias("first")), "names")
    named = rooted.select("identity", "root").join(names, "root").select("identity", F.col("first.id").alias("component_id"), F.col("first.rid").alias("keep"))
    return rows, each.select("rid", "id", "identity"), named


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, budget: int = 128) -> DataFrame:
    """(id, component_id) of the near-duplicates: texts linked by a Jaccard
    similarity of 0.8 or more of their distinct word shingles.

    Candidates come from 512-bit SimHash fingerprints, where 0.8 is 77 bits
    with a deviation of 8, six of which are below the budget, and from anchors
    in place of the first levels of the trie, where all nodes would be open
    pairs: texts of similarity s share one of six least hashes with
    1 - (1 - s)**6, 0.99994 at 0.8. What the candidates chain together is then
    compared by its shingles, and only links of 0.8 or more remain. A node is a
    sequence of words, by a 128-bit hash; two of one and the same single
    shingle are one node, and others with a single shingle have no links."""
    _, each, named = _classes(docs, id_column, text_column, width, budget)
    return each.select("id", "identity").join(named, "identity").select("id", "component_id")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, budget: int = 128) -> DataFrame:
    """``docs`` with one row of each class of near-duplicates: that of the
    least id; of several with that id the one of the least identity of its
    words, and of rows that repeat it the first. An id that has unlike texts
    keeps a row of each. Rows without an id can't be told apart and are all
    kept."""
    rows, _, named = _classes(docs, id_column, text_column, width, budget)
    no_id = F.col("row").getField(id_column).isNull()
    # A class has one row to keep, so rows meet by their numbers and no class is hot.
    keep = named.select(F.col("keep").alias("rid")).distinct()
    held = rows.where(~no_id).join(keep.hint("merge"), "rid", "left_semi").unionByName(rows.where(no_id))
    return held.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
