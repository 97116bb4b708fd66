"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document long, so their Jaccard similarity says
little; what counts is the share of the item's word shingles that the document
holds. Items are partitioned by their number m of distinct shingles (and the
shingles' width). In the partition of size m, containment of t or more leaves
at most m - ceil(t * m) shingles missing, so of the k = m - ceil(t * m) + 1
least hashes of an item (its bottom-k MinHash sketch) the document must hold
one. Documents with fewer shingles than a partition asks for are not probed in
it. The document's shingle hashes are held against the sketches of all
partitions at once, and those that any sketch has are looked up in each
partition's table from hash to items. The search therefore loses nothing;
candidates are then verified by exact shingle containment.

Words are runs of other than ASCII white space, A-Z in lower case. Shingles
have ``width`` words (default five); an item with fewer words is one shingle
of all its words.

The benchmark goes to the tasks in blocks of at most ``block_bytes`` of text,
whose sizes are counted first; more blocks mean more passes over the
documents, never a larger broadcast. A block is held as arrays of word numbers
and hashes and a table of its distinct words, which take some four times its
text; an item's shingles are made when it is a candidate.

Defined cases: a null or empty text holds nothing and is kept; a text of any
length is probed whole, in one worker's memory; an item without words is never
found; items and documents with null identifiers are compared like others;
repeated documents or items give repeated rows; empty tables give no rows; of
other columns only those asked for are read, and ``decontaminate`` keeps all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Items:
    """A block of test items, ready for probing."""

    def __init__(self, texts: list[str | None], threshold: float, width: int):
        self.words: dict[bytes, int] = {}
        #: By width, the sizes' partitions in order: (shingles to hold, sketch hashes, their items).
        self.widths: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        rng = np.random.default_rng(20240229)
        tokens = [words_of(t) for t in texts]
        for ws in tokens:
            for w in ws:
                self.words.setdefault(w, len(self.words))
        self.code = rng.integers(0, 2**63, (width, len(self.words) + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        parts: dict[tuple[int, int], list] = {}
        self.size, self.need = np.zeros((2, len(texts)), np.int32)
        #: Word numbers of all items, and where each item's begin.
        self.flat = np.array([self.words[w] for ws in tokens for w in ws], np.int32)
        self.starts = np.concatenate([[0], np.cumsum([len(ws) for ws in tokens], dtype=np.int64)])
        for item, ws in enumerate(tokens):
            if not ws:
                continue
            n = min(width, len(ws))
            unique = np.unique(self.hashes(self.flat[self.starts[item] : self.starts[item + 1]], n))
            m = len(unique)
            self.size[item], self.need[item] = m, max(1, math.ceil(threshold * m - 1e-9))
            parts.setdefault((n, m), []).append((item, unique[: m - self.need[item] + 1]))
        for (n, m), entries in sorted(parts.items()):
            items = np.repeat(np.array([item for item, _ in entries], np.int32), [len(sketch) for _, sketch in entries])
            keys = np.concatenate([sketch for _, sketch in entries])
            order = np.argsort(keys, kind="stable")
            self.widths.setdefault(n, []).append((self.need[entries[0][0]], keys[order], items[order]))
        self.sketched = {n: np.unique(np.concatenate([keys for _, keys, _ in p])) for n, p in self.widths.items()}

    def shingles(self, item: int, n: int) -> set:
        """An item's shingles, made when it is a candidate."""
        ids = self.flat[self.starts[item] : self.starts[item + 1]].tolist()
        return set(zip(*(ids[k : len(ids) - n + 1 + k] for k in range(n)), strict=True))

    def hashes(self, ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of each ``n`` consecutive word numbers."""
        total = np.zeros(max(0, len(ids) - n + 1), np.uint64)
        for k in range(n):
            part = self.code[k][ids[k : len(ids) - n + 1 + k]]
            total = (total ^ part) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        return total

    def probe(self, text: str | None) -> list[tuple[int, int]]:
        """(item, shared shingles) of the items that the text contains."""
        ws = words_of(text)
        if not ws or not self.words:
            return []
        get = self.words.get
        ids = np.fromiter((get(w, -1) for w in ws), np.int64, len(ws))
        unknown = np.concatenate([[0], np.cumsum(ids < 0)])
        found = []
        for n, parts in self.widths.items():
            windows = len(ids) - n + 1
            if windows < parts[0][0]:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:windows])
            distinct, sketched = np.unique(self.hashes(ids, n)[at]), self.sketched[n]
            place = np.minimum(np.searchsorted(sketched, distinct), len(sketched) - 1)
            hit = distinct[sketched[place] == distinct]
            candidates: set[int] = set()
            for need, keys, items in parts if len(hit) else []:
                if need > windows:
                    break  # so do all larger sizes
                lo, hi = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
                for a, b in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    candidates.update(items[a:b].tolist())
            if candidates:
                here = {tuple(ids[i : i + n].tolist()) for i in at}
                for item in candidates:
                    shared = len(self.shingles(item, n) & here)
                    if shared >= self.need[item]:
                        found.append((item, shared))
        return sorted(found)


def blocks(benchmark: DataFrame, id_column: str, text_column: str, block_bytes: int) -> Iterator[list]:
    """The benchmark's rows (id, text), at most about ``block_bytes`` at once."""
    rows = benchmark.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    n = max(1, math.ceil(2 * size / block_bytes)) if size > block_bytes else 1
    for k in range(n):
        yield rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect() if n > 1 else rows.orderBy("id", "text").collect()


def _finder(items: Items, ids: list, id_kind: str):
    @F.pandas_udf(f"array<struct<item_id:{id_kind},n_shingles:bigint,n_shared:bigint>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"item_id": ids[i], "n_shingles": int(items.size[i]), "n_shared": n} for i, n in items.probe(t)] for t in batch])

    return found


def _cleaner(items: Items):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([not items.probe(t) for t in batch], dtype=bool)

    return clean


def contained(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, block_bytes: int = 16 << 20, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of the pairs where
    the document holds ``threshold`` or more of the item's shingles."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    id_kind = benchmark.schema[item_id].dataType.simpleString()
    out = None
    for rows in blocks(benchmark, item_id, item_text, block_bytes):
        items = Items([r["text"] for r in rows], threshold, width)
        found = _finder(items, [r["id"] for r in rows], id_kind)
        part = source.select("doc_id", F.explode(found("text")).alias("f"))
        part = part.select("doc_id", "f.item_id", "f.n_shingles", "f.n_shared", (F.col("f.n_shared") / F.col("f.n_shingles")).alias("containment"))
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, width: int = 5, block_bytes: int = 16 << 20, doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the documents that contain a test item."""
    for rows in blocks(benchmark, item_id, item_text, block_bytes):
        items = Items([r["text"] for r in rows], threshold, width)
        docs = docs.where(_cleaner(items)(docs[doc_text]))
    return docs
