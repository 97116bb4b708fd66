"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A
text is cut into blocks, each block is compressed with either dictionary, and
the difference of the total sizes, over the larger one, is the feature: text
like the good samples gets smaller with the good dictionary. A logistic curve
fitted on labelled texts that the dictionaries have not seen turns the feature
into a probability. Blocks keep the dictionaries at work all through a long
text, of which every byte counts.

Learning takes a bounded sample of labelled rows: of each class the
``per_class`` identifiers of least hash, of their documents those of
``row_bytes`` at most, and of these, in that order, as many as ``class_bytes``
hold. So the driver receives 2 * class_bytes however large the corpus. Their
texts are used whole: three of four teach the dictionaries, every fourth the
curve. Scoring covers every row and whole texts and shuffles nothing.

Defined cases: null and empty texts have feature 0 and so the curve's value
there; a text of any length is scored whole, in one worker's memory;
identifiers labelled twice count with the lower label, and of rows that repeat
an identifier the least text teaches; labels or identifiers that are null teach
nothing; where a class has fewer than two documents to learn from, scores are
the labels' share (0.5 without labels); repeated rows score alike; an empty
table gives no rows; other columns are kept by ``score``, whose result column
must not be among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
DICTIONARY = 112_640
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float

    def open(self) -> Model:
        import zstandard

        self.coders = []
        for data in (self.good, self.bad):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_content_size=False, write_dict_id=False).compress)
        return self

    def feature(self, text: str | None) -> float:
        """(bad size - good size) / larger size, over all blocks."""
        if not text or not self.good:
            return 0.0
        data = text.encode()
        good, bad = self.coders
        a = b = 0
        for at in range(0, len(data), BLOCK):
            block = data[at : at + BLOCK]
            a += len(good(block))
            b += len(bad(block))
        return (b - a) / max(a, b)

    def score(self, text: str | None) -> float:
        z = self.slope * self.feature(text) + self.offset
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0

    def plain(self) -> Model:
        return Model(self.good, self.bad, self.slope, self.offset)


def is_held_out(id_column: Column, folds: int = 3, held: int = 1) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == held, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_class: int, row_bytes: int, class_bytes: int, id_column: str, text_column: str, label_column: str) -> dict[int, list[str]]:
    """The whole texts of the bounded sample that learning uses, by label."""
    named = labels.select(F.col(id_column).alias("id"), F.col(label_column).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    named = named.where(~is_held_out(F.col("id"))).groupBy("id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).where(F.octet_length("text").between(1, row_bytes))
    order = F.xxhash64("id")
    chosen = None
    for label in (0, 1):
        part = named.where(F.col("label") == label).orderBy(order, "id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    # 2 * per_class rows at most are broadcast; one text for each identifier.
    found = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    size = F.sum(F.octet_length("text").cast("long")).over(Window.partitionBy("label").orderBy(order, "id"))  # per_class rows at most
    rows = found.withColumn("sum", size).where(F.col("sum") <= class_bytes).select("label", "text", order.alias("order"), "id").orderBy("order", "id").collect()
    return {label: [r["text"] for r in rows if r["label"] == label] for label in (0, 1)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of the maximum likelihood curve, by Newton's steps."""
    scale = x.std() or 1.0
    design = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        grad = design.T @ (p - y) + ridge * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2), grad)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, row_bytes: int = 1 << 20, class_bytes: int = 1 << 23, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Model:
    """A model learned from the labels of documents that are not held out."""
    import zstandard

    texts = sample(docs, labels, per_class, row_bytes, class_bytes, id_column, text_column, label_column)
    good, bad = len(texts[1]), len(texts[0])
    if min(good, bad) < 2:
        share = (good + 1) / (good + bad + 2)
        return Model(b"", b"", 0.0, math.log(share / (1 - share)))
    dictionaries = {}
    for label, own in texts.items():
        data = [t.encode() for k, t in enumerate(own) if k % 4]
        blocks = [d[at : at + BLOCK] for d in data for at in range(0, len(d), BLOCK)]
        try:
            dictionaries[label] = zstandard.train_dictionary(DICTIONARY, blocks, level=LEVEL).as_bytes()
        except zstandard.ZstdError:  # too little text to train on: use it as it is
            dictionaries[label] = b"".join(blocks).rjust(8, b" ")
    model = Model(dictionaries[1], dictionaries[0], 0.0, 0.0).open()
    held = [(model.feature(t), label) for label, own in texts.items() for t in own[::4]]
    model.slope, model.offset = logistic(*(np.array(c, float) for c in zip(*held, strict=True)))
    return model.plain()


def scorer(model: Model):
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        opened = model.plain()
        if opened.good:
            opened.open()
        for batch in batches:
            yield pd.Series([opened.score(t) for t in batch], dtype=float)

    return scores


def score(docs: DataFrame, model: Model, text_column: str = "text", score_column: str = "score") -> DataFrame:
    """``docs`` with the probability that its label is 1."""
    if score_column in docs.columns:
        raise ValueError(f"the documents have a column {score_column} already")
    return docs.withColumn(score_column, scorer(model)(docs[text_column]))
