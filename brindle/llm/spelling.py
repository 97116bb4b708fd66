"""Spelling variants: words one edit apart, found in a positional q-gram index.

Words are the runs of letters of whole texts, counted over the corpus. Two are
near if they differ by exactly one inserted, deleted or replaced code point. A
word's form is its most frequent near word, if that is ``ratio`` times as
frequent; its root is where the forms lead.

The index is an inverted one: for each q-gram and position the words that hold
it there, in order. A probe's postings are merged by a heap under the length
and position limits of one edit (as long, or one longer; same place, or one
further), and words that occur in enough of them are compared in full. One edit
spoils at most q of a word's q-grams, so near words share at least
max(length) - 2 q + 1 of them: this is the least count that is kept.

Parts of the index. One edit leaves one half of a word as it is, so words meet
by (length, half, which half): each word goes to at most four parts, two for
its own length and two for those one shorter. A part of more than ``most``
words is parted again, by the halves of what is not yet known to agree, and so
on until it is small or one code point is left, when no more words than letters
can differ in it. No part is unbounded, however the words are distributed, none
is cut off, and a pair is reported by the one part that holds the leftmost
place at which its edit can be.

Defined cases: a null text has no words, a null identifier is written as an
empty one; repeated rows count as often as they are there; texts and words of
any length are taken whole; an empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heapreplace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.store import discard, materialize

Q = 2
RATIO = 10
#: Words of a part that a task may hold, and of one that is indexed as it is.
MOST, LEAF = 20_000, 64


def counter(batches: Iterable, least: int, drop_every: int | None) -> Iterator:
    """(word, n) of batches of (id, text), summed up over some 100,000 words."""
    import re
    import zlib
    from collections import Counter

    import pyarrow as pa

    from brindle.llm.memory import give_back

    run = re.compile("[A-Za-zÀ-ÿ]{%d,}" % least)
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    found: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})
        found.clear()
        return batch

    for batch in batches:
        for i, text in zip(batch.column(0), batch.column(1), strict=True):
            text = (text.as_py() or "").encode().translate(low).decode()
            start = zlib.crc32(f"{'' if i.as_py() is None else i.as_py()}:".encode())
            for w, n in Counter(run.findall(text)).items():
                if drop_every and (h := zlib.crc32(w.encode(), start)) % drop_every == 0:
                    k = h % len(w)
                    w = w[:k] + w[k + 1 :]
                    if len(w) < least:
                        continue
                found[w] += n
            if len(found) > 100_000:
                yield out()
    yield out()
    give_back()


def count_words(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 7, drop_every: int | None = None) -> DataFrame:
    """(word, n): the runs of at least ``least`` letters, A-Z lower-cased, and
    how often they occur. With ``drop_every`` a word of a document loses a
    letter where that number divides the CRC-32 of ``<id>:<word>``: misspelling
    made for tests of what is found."""
    given = docs.select(docs[id_column], docs[text_column])
    return given.mapInArrow(lambda b: counter(b, least, drop_every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def merged(lists: list[list[int]], need: int) -> Iterator[int]:
    """What occurs in at least ``need`` of the ordered lists, each once; a heap
    of the lists' heads merges them."""
    if len(lists) < need:
        return
    heads = []
    for k, postings in enumerate(lists):
        rest = iter(postings)
        heads.append((next(rest), k, rest))
    heapify(heads)
    last, n = -1, 0
    while heads:
        x, k, rest = heads[0]
        last, n = x, n + 1 if x == last else 1
        if n == need:
            yield x
        following = next(rest, None)
        if following is None:
            heappop(heads)
        else:
            heapreplace(heads, (following, k, rest))


def edit_place(s: str, t: str) -> int | None:
    """The leftmost place in ``s`` at which one edit makes it ``t``, which is
    as long or one longer; None if none does."""
    n = len(s)
    behind = 0
    while behind < n and s[n - 1 - behind] == t[-1 - behind]:
        behind += 1
    more = len(t) - n
    if more == 0:
        return n - 1 - behind if behind < n and s[: n - 1 - behind] == t[: n - 1 - behind] else None
    return n - behind if s[: n - behind] == t[: n - behind] else None


def leaves(words: list, size: int, a: int, b: int, most: int) -> Iterator[tuple[list, int, int]]:
    """Small parts of a part whose words of length ``size`` agree outside of
    [a, b), and those one longer outside of [a, b + 1)."""
    if len(words) < 2:
        return
    if len(words) <= most or b - a <= 1:
        yield words, a, b
        return
    m = (a + b) // 2
    first: dict = {}
    second: dict = {}
    for x in words:
        first.setdefault(x[0][len(x[0]) - (size - m) :], []).append(x)
        second.setdefault(x[0][:m], []).append(x)
    for some in first.values():
        yield from leaves(some, size, a, m, most)
    for some in second.values():
        yield from leaves(some, size, m, b, most)


def near_in(words: list, size: int, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Near pairs, as places in ``words``, whose leftmost edit is in [a, b)."""
    lo, hi = max(0, a - Q + 1), min(size, b + Q - 1)  # q-grams outside agree
    touched = hi - lo - Q + 1
    even: dict = {}
    longer: dict = {}
    probes = []
    for j, (w, _) in enumerate(words):
        if len(w) == size:
            probes.append(j)
            continue
        for p in range(lo, hi - Q + 2):
            g = w[p : p + Q]
            if p <= hi - Q:
                longer.setdefault((g, p), []).append(j)
            if p > lo:
                postings = longer.setdefault((g, p - 1), [])
                if not postings or postings[-1] != j:
                    postings.append(j)
    some = [j for j, (w, _) in enumerate(words) if len(w) > size]
    for n, i in enumerate(probes):
        s = words[i][0]
        grams = [(s[p : p + Q], p) for p in range(lo, hi - Q + 1)]
        for index, need, every in ((even, touched - Q, probes[:n] if touched <= Q else ()), (longer, touched - Q + 1, some if touched < Q else ())):
            found = merged([index[g] for g in grams if g in index], need) if need > 0 else every
            for j in found:
                at = edit_place(s, words[j][0])
                if at is not None and (a <= at < b or at == b == size):
                    yield i, j
        for g in grams:
            even.setdefault(g, []).append(i)


def searched(batches: Iterable) -> Iterator:
    """Of batches of (part, size, a, b, word, n) in order of part: for each
    word that has near ones in a part, how many, and the most frequent."""
    import pyarrow as pa

    from brindle.llm.memory import give_back

    out: list = []

    def search(key: tuple, words: list) -> None:
        _, size, a, b = key
        words.sort()
        for some, lo, hi in leaves(words, size, a, b, LEAF):
            best: dict = {}
            for i, j in near_in(some, size, lo, hi):
                for x, y in ((i, j), (j, i)):
                    this = (-some[y][1], some[y][0])
                    count, first = best.get(x, (0, this))
                    best[x] = count + 1, min(first, this)
            out.extend((some[x][0], count, -first[0], first[1]) for x, (count, first) in best.items())

    def batch():
        got = pa.RecordBatch.from_pydict(dict(zip(("word", "n_near", "near_n", "near"), zip(*out, strict=True), strict=True)), pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())]))
        out.clear()
        return got

    key, held = None, []
    for given in batches:
        for row in zip(*(c.to_pylist() for c in given.columns), strict=True):
            if row[:4] != key:
                if len(held) > 1:
                    search(key, held)
                key, held = row[:4], []
                if len(out) > 20_000:
                    yield batch()
            held.append(row[4:])
    if len(held) > 1:
        search(key, held)
    if out:
        yield batch()
    give_back()


def _halves(parts: DataFrame) -> DataFrame:
    """Each word of parts (size, a, b, word, n) in the two parts of what is
    left if either half of [a, b) is known to agree as well."""
    m = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    behind = lambda at: F.col("size") - at  # noqa: E731  code points that agree at the end, where [a, at) is in doubt
    word = F.col("word")
    tail = lambda at: F.substr(word, F.char_length(word) - behind(at) + 1, behind(at))
    sides = F.array(
        F.struct(F.col("a"), m.alias("b"), F.substr(word, F.lit(1), F.col("a")).alias("head"), tail(m).alias("tail")),
        F.struct(m.alias("a"), F.col("b"), F.substr(word, F.lit(1), m).alias("head"), tail(F.col("b")).alias("tail")),
    )
    split = parts.select("size", "word", "n", F.explode(sides).alias("s"))
    return split.select(F.xxhash64("size", "s.a", "s.b", "s.head", "s.tail").alias("part"), "size", "s.a", "s.b", "word", "n")


def near_words(words: DataFrame, least: int = 7, most: int = MOST) -> DataFrame:
    """(word, n_near, form, form_n) for each of ``words`` (distinct word, n)
    that has near ones: how many, and the most frequent of them (of several
    the first in code-point order). A part is known by a 64-bit hash; parts
    whose hashes are equal are searched as one, which changes no result."""
    size = F.explode(F.when(F.char_length("word") > least, F.array(F.char_length("word"), F.char_length("word") - 1)).otherwise(F.array(F.char_length("word"))))
    open_parts = words.where(F.char_length("word") >= least).select(size.alias("size"), "word", "n").withColumn("a", F.lit(0)).withColumn("b", F.col("size"))
    done, tables = None, []
    while open_parts is not None:
        parts = materialize(_halves(open_parts), "parts")
        tables.append(parts)
        hot = materialize(parts.where("b - a > 1").groupBy("part", "size", "a", "b").count().where(F.col("count") > most).drop("count"), "hot_parts")
        tables.append(hot)
        key = ["part", "size", "a", "b"]
        if hot.isEmpty():
            cold, open_parts = parts, None
        else:
            cold, open_parts = parts.join(hot, key, "left_anti"), parts.join(hot, key, "left_semi").drop("part")
        done = cold if done is None else done.unionByName(cold)
    dealt = done.select("part", "size", "a", "b", "word", "n").repartition("part").sortWithinPartitions("part", "size", "a", "b")
    found = dealt.mapInArrow(searched, "word string, n_near long, near_n long, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    out = materialize(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "near")
    for t in tables:
        discard(t)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the (word, form) given: the last of the forms that a
    word leads to. Each round follows twice as many; forms are ``ratio`` times
    as frequent as their words, so there are few."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        then = materialize(now.join(on, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        discard(now)
        now = then.drop("moved")
        now._brindle_path = then._brindle_path
        if then.where("moved").isEmpty():
            return now


def variants(counted: DataFrame, least: int = 7, at_least: int = 2, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word counted
    ``at_least`` times: see the module."""
    words = materialize(counted.where(F.col("n") >= at_least).select("word", "n"), "words")
    near = near_words(words, least)
    strong = F.col("form_n") >= ratio * F.col("n")
    held = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n"))
    held = materialize(held, "forms")
    discard(near)
    discard(words)
    out = held.join(roots(held.where(F.col("form").isNotNull())), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
