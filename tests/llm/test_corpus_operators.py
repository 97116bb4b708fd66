"""Operators over whole tables against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from brindle.llm import bpe, classifier, components, decontaminate, queries, sharding, simhash, store, warc

VOCABULARY = queries.vocabulary_path()


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def corpus():
    rng = random.Random(7)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(25)]
    texts = []
    for t in base:
        texts += [t, t, t.upper()]
        near = t.split(" ")
        near[5] = "changed"
        texts += [" ".join(near), t + " tail"]
    return [(i * 3, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (4, " \n"), (5, "one"), (7, "ONE"), (8, "one two")]


@pytest.mark.parametrize("max_node", [20_000, 4])
def test_simhash_classes(spark, max_node):
    rows = corpus()
    prints = {i: plain_fingerprint(t) for i, t in rows}
    want = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("id", F.lit(0))
    got = simhash.classes(df, max_node=max_node).collect()
    assert {r.id: r.component_id for r in got} == want and len(got) == len(rows)
    assert {r.id: r.fp % 2**64 for r in got} == prints


def test_simhash_hot_node(spark):
    rng = np.random.default_rng(1)
    flips = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    fps = np.unique(np.uint64(0x0123456789ABCDEF) ^ flips(400) ^ flips(400)).view(np.int64)
    want = groups(fps.tolist(), lambda a, b: ((a ^ b) % 2**64).bit_count() <= 2)
    df = spark.createDataFrame([(int(x),) for x in fps], "fp long")
    for size in (10**6, 20):
        found = {r.node: r.root for r in components.components(simhash.links(df, max_node=size)).collect()}
        assert {x: found.get(x, x) for x in want} == want


def test_links_come_from_the_descent(spark, monkeypatch):
    """From the root pair: levels by DataFrames, then by arrays, and as many
    places as the budget allows."""
    rng = np.random.default_rng(8)
    fps = np.unique(rng.integers(-(2**63), 2**63, 300))
    walked, compared, real, leaves = [], [], simhash._descend, simhash._leaves
    monkeypatch.setattr(simhash, "_descend", lambda rows, *a: walked.append(out := real(rows, *a)) or out)
    simhash.links(spark.createDataFrame([(int(x),) for x in fps], "fp long")).collect()
    assert len(walked) == 1 and walked[0].count() == len(fps) * (1 + 6 + 15)
    monkeypatch.setattr(simhash, "_leaves", lambda fps, al, na, bl, nb, *a: compared.append(int((na * nb).sum())) or leaves(fps, al, na, bl, nb, *a))
    words = np.sort(fps.view(np.uint64)).reshape(-1, 1)
    near = words.copy()
    near[:50] ^= np.uint64(5)
    both = np.unique(np.concatenate([words, near]), axis=0)
    n = np.array([len(both)])
    got = {(int(i), int(j)) for a, b in simhash.trie_pairs(both, np.array([0]), n, n, 2) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(both)) for j in range(i + 1, len(both)) if (int(both[i, 0]) ^ int(both[j, 0])).bit_count() <= 2}
    assert got == want and len(want) >= 50 and sum(compared) < len(both) ** 2 / 4 and len(compared) > 3


def test_simhash_query_keeps_its_contract(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    got = queries.op3_simhash_dedup(spark, sf).collect()
    assert len(got) == len(texts) and {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{p:016x}", want[i]) for i, p in prints.items()}


def test_simhash_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (9, "a b c"), (9, "a b c"), (None, "lone text here")], "doc_id long, text string")
    got = simhash.classes(df).collect()
    assert sorted((str(r.id), str(r.component_id)) for r in got) == [("9", "9"), ("9", "9"), ("None", "9"), ("None", "None")]
    assert simhash.classes(df.limit(0)).count() == 0
    kept = simhash.deduplicate(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["9", "None", "None"]


@pytest.mark.parametrize("max_node", [2048, 3])
def test_near_classes_find_similar_texts(spark, monkeypatch, max_node):
    rng = random.Random(3)
    words = ["v%d" % i for i in range(5000)]
    rows, origin = [], {}
    for k in range(30):
        t = rng.choices(words, k=200)
        for copy in range(4):
            u = list(t)
            for _ in range(copy):
                u[rng.randrange(200)] = "edit%d" % rng.randrange(1000)
            origin[len(rows)] = k
            rows.append((len(rows), " ".join(u)))
    real = simhash.wide_links
    monkeypatch.setattr(simhash, "wide_links", lambda n, b: real(n, b, max_node))
    got = {r.id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    shingles = {i: {tuple(t.split()[j : j + 5]) for j in range(196)} for i, t in rows}
    for a in got:
        for b in got:
            same = len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
            if same >= 0.85:
                assert got[a] == got[b]
            if origin[a] != origin[b]:
                assert got[a] != got[b]


def at_the_threshold():
    """Texts of 180 shingles: each one, then with 4 and 5 edits apart from each
    other, which leave 160 of 200 (0.8) and 155 of 205 (0.756) in common."""
    rng, words, rows = random.Random(11), ["x%d" % i for i in range(5000)], []
    for k in range(20):
        base = rng.sample(words, 184)
        for edits, first in ((0, 0), (4, 10), (5, 15)):
            u = list(base)
            for e in range(edits):
                u[first + 32 * e] = f"edit{k}x{edits}x{e}"
            rows.append((len(rows), " ".join(u)))
    return rows


@pytest.mark.parametrize("max_members", [1024, 2])
def test_near_classes_hold_at_the_threshold(spark, monkeypatch, max_members):
    real = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda t, w: real(t, w, max_members))
    got = {r.id: r.component_id for r in simhash.near_classes(spark.createDataFrame(at_the_threshold(), "doc_id long, text string")).collect()}
    assert got == {i: i - (i % 3 == 1) for i in range(60)}


@pytest.mark.parametrize("max_members", [1024, 5, 2])
def test_similar_links_equal_brute_force(spark, max_members):
    """Chains of near copies in one candidate class: links that only members
    far from a class's least one have, blocks of any size, and no text twice."""
    rng, rows, words = random.Random(9), [], ["y%d" % i for i in range(400)]
    for _ in range(6):
        t = rng.sample(words, 60)
        for step in range(9):
            rows.append(" ".join(t))
            for _ in range(1 + step % 2):
                t = t[:-2] + [f"e{rng.randrange(10**6)}"] if rng.random() < 0.5 else [f"e{rng.randrange(10**6)}"] + t[1:]
            if step == 4:
                t[30] = "middle"
    rows = list(dict.fromkeys(rows))
    sets = [simhash.shingle_hashes(t) for t in rows]
    jaccard = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    want = groups(range(len(rows)), lambda a, b: jaccard(a, b) >= 0.8)
    assert 6 < len(set(want.values())) < len(rows)
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(rows)], "root long, node long, text string")
    found = {r.node: r.root for r in components.components(simhash.similar_links(df, 5, max_members)).collect()}
    assert {i: found.get(i, i) for i in range(len(rows))} == want


def test_similar_equals_brute_force():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 14, 12).astype(np.uint64)) for _ in range(60)] + [np.empty(0, np.uint64)]
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) if len(a) + len(b) else 1
    want = groups(range(61), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
    assert len(set(want.values())) > 3 and dict(enumerate(simhash.similar(sets).tolist())) == want


@pytest.mark.parametrize("max_node", [2048, 3])
def test_wide_links_need_one_common_anchor(spark, max_node):
    rng = np.random.default_rng(2)
    base, rows = [rng.bytes(64) for _ in range(6)], []
    for k in range(40):
        fp = bytearray(base[k % 6])
        fp[k] ^= 1
        rows.append((k, bytes(fp), [7, *(100 * k + j for j in range(5))]))
    df = spark.createDataFrame(rows, "node long, fp binary, anchors array<long>")
    found = {r.node: r.root for r in components.components(simhash.wide_links(df, 92, max_node)).collect()}
    assert {k: found.get(k, k) for k in range(40)} == {k: k % 6 for k in range(40)}


def test_containment_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["u%d" % i for i in range(200)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for k in range(30)] + [(50, None), (51, ""), (52, "dup dup dup dup dup dup dup"), (52, "dup dup dup dup dup dup dup"), (None, "u1 u2 u3")]
    docs = [(0, None), (1, ""), (2, "dup " * 9), (None, "U1 u2 u3 " + "filler " * 50_000)]
    for k in range(60):
        t = rng.choices(words, k=300)
        if k % 2:
            item = (items[k % 30][1] or "").upper().split()
            if k % 4 == 1 and len(item) > 12:
                item[-1] = "altered"
            t[50:50] = item
        docs.append((k + 3, " ".join(t)))

    def shingles(t, n):
        w = (t or "").lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()

    want = []
    for d, text in docs:
        for i, item in items:
            n = min(5, len((item or "").split()))
            s = shingles(item, n) if n else set()
            shared = len(s & shingles(text, n)) if n else 0
            if s and shared >= 0.8 * len(s):
                want.append((d, i, len(s), shared))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0)), spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 24, 500):
        got = decontaminate.contained(df, bench, block_bytes=block).collect()
        none_last = lambda rows: sorted(rows, key=lambda r: [(x is None, x or 0) for x in r])
        assert none_last((r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got) == none_last(want)
        kept = {r.doc_id for r in decontaminate.decontaminate(df, bench, block_bytes=block).collect()}
        assert kept == {d for d, _ in docs} - {w[0] for w in want}
    assert decontaminate.contained(df, bench.limit(0)).count() == 0 and decontaminate.contained(df.limit(0), bench).count() == 0


ODD = [(1, None), (2, ""), (3, "a<|endoftext|>b  <|endoftext|> don't  \n\n x\t y \U0001F600 123abć \x85 ​"), (None, "x"), (3, "dup"), (4, " "), (5, "it's IT'S \r\n\r\n  end  "), (6, "한글 中文 ½²٣ _-_ ﬁ\0x \0 y"), (7, "　 wide  spaces  here "), (8, "long " * 5000), (8, "long " * 5000)]


@pytest.mark.parametrize("chunk", [1 << 24, 30])
def test_bpe_equals_the_library(spark, chunk):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    coded = bpe.encode(df, VOCABULARY, chunk_chars=chunk, bucket_words=chunk)
    got = sorted(((r.id is None, r.id), list(r.ids), r.decoded) for r in bpe.decode(coded, VOCABULARY).collect())
    want = sorted(((i is None, i), t.encode(x or "", add_special_tokens=False).ids, t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, x in ODD)
    assert got == want


def test_bpe_query_equals_the_library(spark):
    from tokenizers import Tokenizer

    t, sf = Tokenizer.from_file(VOCABULARY), "/root/testdata/sf0.001"
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    got = queries.op10_bpe(spark, sf).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_bpe_encodes_each_distinct_word_once(spark, monkeypatch):
    """However many chunks ask for it, and with few words to a bucket."""
    import pyarrow as pa
    import tokenizers

    asked = []

    class Counting:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode_batch(self, words, **options):
            asked.extend(words)
            return self.real.encode_batch(words, **options)

    class Files:
        @staticmethod
        def from_file(path):
            return Counting(real(path))

    real = tokenizers.Tokenizer.from_file
    monkeypatch.setattr(tokenizers, "Tokenizer", Files)
    words = ["one", " two", " three", ""]
    request = lambda chunk, own: (chunk, 7, bpe.pack_words(pa.array(own)))
    rows = [request(1, words[:3]), request(2, words[1:]), request(3, words)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["chunk", "bucket", "words"])
    out = pa.Table.from_batches(bpe._encode_words(VOCABULARY)(iter([batch])))
    assert sorted(asked) == sorted(words)
    for own, counts, ids in zip([words[:3], words[1:], words], out.column("counts"), out.column("word_ids"), strict=True):
        want = [real(VOCABULARY).encode(w, add_special_tokens=False).ids for w in own]
        assert bpe.unpack(counts.as_py()).tolist() == list(map(len, want)) and bpe.unpack(ids.as_py()).tolist() == sum(want, [])


def test_bpe_buckets_follow_the_distinct_words(spark):
    df = spark.createDataFrame([(k, " ".join(f"w{j}" for j in range(k, k + 400))) for k in range(0, 20_000, 100)], "doc_id long, text string").repartition(4)
    words = [f"w{j}" for j in range(20_300)]
    kind = bpe.CHUNK.format(kind="bigint")
    made = df.select("doc_id", bpe.words_of(F.col("text"), []).alias("w")).mapInArrow(bpe._chunks(5000), kind)
    assert bpe.distinct_words(made) == pytest.approx(len(words), rel=0.25)
    few = df.limit(1).select("doc_id", bpe.words_of(F.lit("a b a b"), []).alias("w")).mapInArrow(bpe._chunks(5000), kind)
    assert bpe.distinct_words(few) == 3


def test_bpe_words_are_the_text(spark):
    from tokenizers import Tokenizer

    t, added = Tokenizer.from_file(VOCABULARY), bpe.added_tokens(VOCABULARY)
    for r in spark.createDataFrame(ODD, "doc_id long, text string").withColumn("w", bpe.words_of(F.col("text"), added)).collect():
        assert "".join(r.w) == (r.text or "")
        assert [i for w in r.w for i in t.encode(w, add_special_tokens=False).ids] == t.encode(r.text or "", add_special_tokens=False).ids


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [10, None, 99_999_999, 11]), (4, [232])], "k int, ids array<int>")
    assert [(r.k, r.ids, r.decoded) for r in bpe.decode(df, VOCABULARY).orderBy("k").collect()] == [(1, None, None), (2, [], ""), (3, [10, None, 99_999_999, 11], "+,"), (4, [232], "\ufffd")]
    many = spark.createDataFrame([(k, [10 + k % 3] * (k % 1500), ["t"] * (k % 4), {"m": k}) for k in range(0, 3000, 7)], "k int, ids array<int>, more array<string>, map map<string,int>")
    for r in bpe.decode(many.coalesce(1), VOCABULARY, text_column="text").collect():
        assert r.text == "+,-"[r.k % 3] * len(r.ids) and r.ids == [10 + r.k % 3] * (r.k % 1500) and r.more == ["t"] * (r.k % 4) and r.map == {"m": r.k}
    with pytest.raises(ValueError):
        bpe.decode(df.withColumn("decoded", F.lit("")), VOCABULARY)


def test_bpe_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY).count() == 0


def test_shards_are_exact_and_mixed(spark):
    df = spark.range(1003).select(F.when(F.col("id") > 2, F.col("id")).alias("doc_id"), F.lit("x").alias("cell"), F.lit(0).alias("part")).repartition(7)
    got = sharding.shard_rows(df, 24, block_rows=10).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert sorted(map(len, by.values())) == [41] * 5 + [42] * 19
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == list(range(3, 1003)) and got[0].cell == "x"
    again = sharding.shard_rows(df, 24, block_rows=10)
    assert again.count() == 1003 and sharding.shard_rows(df.limit(0), 24).count() == 0
    with pytest.raises(ValueError):
        sharding.shard_rows(df.withColumn("slot", F.lit(1)), 24)


def test_shard_query_deals_whole_documents(spark, monkeypatch):
    sf, seen, real = "/root/testdata/sf0.001", [], sharding.shard_rows
    monkeypatch.setattr(sharding, "shard_rows", lambda rows, **k: seen.append(out := real(rows, **k)) or out)
    got = queries.op4_uniform_shards(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert seen[0].columns == [*docs.columns, "shard", "slot"]
    dealt = {r.doc_id: ((r.text or "").encode(), r.shard, r.slot) for r in seen[0].collect()}
    assert {i: t for i, (t, _, _) in dealt.items()} == {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted((i, len(t) + 8, zlib.crc32(t), k, at) for i, (t, k, at) in dealt.items())


def test_blocks_are_bounded_by_bytes_and_parts_by_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PART_BITS", 4)
    df = spark.range(300).select("id", F.repeat(F.lit("x"), 984).alias("text"), F.array("id").alias("ids")).repartition(3)
    got = sharding.shard_rows(df, 2, block_bytes=20_000).collect()
    assert sorted(r.id for r in got) == list(range(300))
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(2) for k in range(150)]
    assert all(r.ids == [r.id] and len(r.text) == 984 for r in got)


def test_matrix_has_its_margins_and_mean():
    parts, sizes = [5, 0, 17, 40, 38], np.array([30, 30, 40])
    ends = np.concatenate([[0], np.cumsum(parts)])
    total = np.zeros((5, 3))
    for seed in range(400):
        m = np.array([sharding.matrix_row(p, ends, sizes, seed) for p in range(5)])
        assert (m.sum(1) == parts).all() and (m.sum(0) == sizes).all() and (m >= 0).all()
        total += m
    assert np.abs(total / 400 - np.outer(parts, sizes) / 100).max() < 0.5
    big = sharding.draw(np.random.default_rng(0), np.array([3 * 10**9, 10**9]), 10**9)
    assert big.sum() == 10**9 and abs(big[0] - 75 * 10**7) < 10**6


def test_blocks_are_even():
    for rows, shards, most in ((1003, 24, 10), (0, 3, 5), (5, 8, 5), (10**6, 7, 999)):
        shard, first, size = sharding.cells(rows, shards, most)
        for s, n in enumerate(sharding.shard_sizes(rows, shards)):
            own = shard == s
            assert size[own].sum() == n and (first[own] == np.cumsum(size[own]) - size[own]).all() and size[own].max() - size[own].min() <= 1 and size[own].max() <= most
        assert max(sharding.shard_sizes(rows, shards)) - min(sharding.shard_sizes(rows, shards)) <= 1


@pytest.mark.parametrize("good, bad, n", [(30, 50, 40), (500, 100, 550), (17, 400, 100), (3, 2, 4), (0, 5, 3), (40, 9, 49)])
def test_large_draws_have_the_exact_law(good, bad, n):
    from math import comb

    rng, tries = np.random.default_rng(5), 4000
    got = np.bincount([sharding.large_draw(rng, good, bad, n) for _ in range(tries)], minlength=good + 1)
    want = np.array([comb(good, k) * comb(bad, n - k) / comb(good + bad, n) if 0 <= n - k <= bad else 0 for k in range(good + 1)])
    assert not got[want == 0].any()
    often = want * tries >= 5
    assert (((got - want * tries) ** 2)[often] / (want * tries)[often]).sum() < often.sum() + 5 * np.sqrt(2 * often.sum())


def test_large_draws_beyond_numpy():
    rng = np.random.default_rng(6)
    good, bad, n = 3 * 10**11, 5 * 10**11, 10**11
    z = [(sharding.large_draw(rng, good, bad, n) - n * good / (good + bad)) / np.sqrt(n * (3 / 8) * (5 / 8) * (7 / 8)) for _ in range(300)]
    assert abs(np.mean(z)) < 0.25 and 0.85 < np.std(z) < 1.15
    assert [sharding.large_draw(rng, 10**12, 1, 10**12) for _ in range(5)] >= [10**12 - 1] * 5


@pytest.mark.parametrize("file_rows", [1 << 20, 7])
def test_shards_are_written_in_order(spark, tmp_path, file_rows):
    import pyarrow.parquet as pq

    df = spark.range(200).withColumn("text", F.lit("x"))
    sharding.write_shards(sharding.shard_rows(df, 3), f"file://{tmp_path}/out", file_rows)
    back, ids = defaultdict(list), []
    for file in sorted((tmp_path / "out").rglob("*.parquet")):
        t = pq.ParquetFile(file).read()
        slots = t.column("slot").to_pylist()
        assert slots == sorted(slots) and len(slots) <= file_rows
        back[file.parent.name] += slots
        ids += t.column("id").to_pylist()
    assert sorted(ids) == list(range(200)) and {k: sorted(v) for k, v in back.items()} == {f"shard={s}": list(range(n)) for s, n in enumerate((67, 67, 66))}


def test_shard_query_keeps_its_contract(spark):
    got = queries.op4_uniform_shards(spark, "/root/testdata/sf0.001").collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(s) for s in slots.values()]
    assert set(slots) == set(range(24)) and max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}


def test_warc_round_trip(spark):
    long = "<p>" + "x" * 1200
    rows = [(1, "http://a/ b\r\n", long), (5, None, long), (3, "u", long), (2, "u", "short"), (4, "u", "short"), (None, "u", long), (6, "u", None), (7, "u", "é" * 700), (7, "u", "é" * 700), (None, "u", "only null" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).repartition(3)
    folder = warc.new_folder(spark)
    index = warc.write(df, folder, frame_bytes=1500, bundle_bytes=2000)
    got = warc.read(index, folder).collect()
    payload = {p: (h or "").encode() for p, _, h in rows}
    assert sorted((str(r.record_id), r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("1", "revisit", "5"), ("3", "revisit", "5"), ("5", "response", "None"), ("None", "revisit", "5"), ("None", "response", "None"), ("2", "response", "None"), ("4", "response", "None"), ("6", "response", "None"), ("7", "response", "None"), ("7", "response", "None")]
    )
    for r in got:
        if r.record_id is not None:
            assert r.payload_digest == hashlib.sha1(payload[r.record_id]).hexdigest() and r.payload_bytes == len(payload[r.record_id])
            assert r.record_type == "revisit" or bytes(r.payload) == payload[r.record_id]
    one = warc.lookup(index, folder, spark.createDataFrame([(2,)], "record_id long")).collect()
    assert [bytes(r.payload) for r in one] == [b"short"]
    none = warc.write(df.limit(0), warc.new_folder(spark))
    assert none.count() == 0 and warc.read(none, folder).count() == 0


def test_warc_headers():
    for kind, refers in (("response", None), ("revisit", 9)):
        fields, body = warc.parse(warc.record(4, "http://a", kind, b"pay", "d1", refers, "2024-01-31T12:00:00Z"))
        assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(fields) and int(fields["Content-Length"]) == len(body)
        assert (fields.get("WARC-Profile"), fields.get("WARC-Refers-To")) == ((warc.PROFILE, "<urn:record:9>") if refers else (None, None))


def test_bundle_is_a_plain_zstd_stream(spark, tmp_path):
    import io

    import zstandard

    out = io.BytesIO()
    out.close = lambda: None
    bundle = warc.Bundle(out, 50)
    places = [(bundle.add(d), d) for d in (b"a" * 30, b"b" * 30, b"c" * 10)]
    bundle.close()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read() == b"a" * 30 + b"b" * 30 + b"c" * 10
    assert [p for p, _ in places] == [(0, 0), (0, 30), (1, 0)]


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels)
    rows = classifier.score(docs, model).join(labels, "doc_id").where(classifier.is_held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.9 and all(0 <= s <= 1 for s in good + bad)


def test_classifier_against_its_own_steps(spark):
    """Sizes by the library, the curve as the likelihood's maximum, and whole
    texts from training to scores."""
    import zstandard

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    texts = classifier.sample(docs, labels, 1500, 1 << 20, 1 << 23, "doc_id", "text", "quality")
    by_id = {r.doc_id: r.text for r in docs.collect()}
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and by_id.get(r.doc_id)}
    assert {x: sorted(t) for x, t in texts.items()} == {x: sorted(by_id[i] for i, q in known.items() if q == x) for x in (0, 1)}
    model = classifier.fit(docs, labels)

    def feature(text):
        sizes = []
        for data in (model.good, model.bad):
            coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(coder.compress(text.encode()[k : k + 1024])) for k in range(0, len(text.encode()), 1024)))
        return (sizes[1] - sizes[0]) / max(sizes) if text else 0.0

    for r in queries.op8_quality_classifier(spark, "/root/testdata/sf0.001").collect():
        x = 1 / (1 + np.exp(-(model.slope * feature(by_id[r.doc_id] or "") + model.offset)))
        assert r.score == pytest.approx(x, abs=0.02) and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = np.array([(feature(t), x) for x, own in texts.items() for t in own[::4]])
    p = 1 / (1 + np.exp(-(model.slope * held[:, 0] + model.offset)))
    assert abs((p - held[:, 1]).sum()) < 0.1


def test_classifier_sample_is_bounded_by_rows(spark):
    docs = spark.createDataFrame([(i, "word " * (i + 1)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = classifier.sample(docs, labels, 10, 200, 500, "doc_id", "text", "quality")
    whole = {("word " * (i + 1)) for i in range(60)}
    for own in got.values():
        assert 0 < len(own) <= 10 and set(own) <= whole and max(map(len, own)) <= 200 and sum(map(len, own)) <= 500


def test_classifier_odd_inputs(spark):
    with pytest.raises(ValueError):
        classifier.score(spark.createDataFrame([(1, "x", 0.5)], "doc_id long, text string, score double"), classifier.Model(b"", b"", 0.0, 0.0))
    assert classifier.score(spark.createDataFrame([], "doc_id long, text string"), classifier.Model(b"", b"", 0.0, 0.0)).count() == 0
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x y"), (4, "good text"), (4, "good text")], "doc_id long, text string").withColumn("label", F.lit(1))
    for labels in ([], [(4, 1)], [(1, 0), (2, 1), (4, 1), (4, 0), (None, 1)]):
        model = classifier.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert all(0 <= r.score <= 1 for r in classifier.score(docs, model).collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200)] + [(300, 301 + i) for i in range(50)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100} | {301 + i: 300 for i in range(50)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_tables_laid_out_by_a_column(spark):
    kept = store.materialize_by(spark.range(50).withColumn("k", F.col("id") % 7), "t", "k", 3)
    assert "Exchange" not in kept.groupBy("k").count()._jdf.queryExecution().executedPlan().toString() and kept.groupBy("k").count().count() == 7
    name = store._tables[kept._brindle_path]
    store.discard(kept)
    assert not spark.catalog.tableExists(name)


def test_shared_folder_follows_the_session(spark, monkeypatch):
    assert store.shared_dir(spark)
    kept, other = (store.materialize(spark.range(3), "t", keep=k) for k in (True, False))
    assert kept.count() == 3 and kept._brindle_path not in store._written and other._brindle_path in store._written
    store.discard(kept)
    monkeypatch.setattr(store, "_written", {other._brindle_path: spark})
    store.release()
    assert not store._written

    class Context:
        master, _conf = "local-cluster[2,1,1024]", {}

    class Session:
        conf, sparkContext = {}, Context

    with pytest.raises(RuntimeError):
        store.shared_dir(Session)
    Context.master = "local[4]"
    assert store.shared_dir(Session).startswith("file:")


def test_deduplicate_keeps_rows_and_not_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in ("left", "right"))
    rows = [(2, a), (3, a), (3, b), (4, a.replace("left7 ", "other ")), (5, "one two"), (5, "ONE two"), (6, "one two three"), (7, "w " * 9), (8, "w w w w w"), (9, b + " end")]
    for given in (rows, rows[::-1], rows[3:] + rows[:3]):
        df = spark.createDataFrame(given, "doc_id long, text string").withColumn("rid", F.lit("clash")).withColumn("identity", F.lit(1))
        kept = simhash.deduplicate(df)
        assert kept.columns == df.columns
        got = sorted((r.doc_id, r.text.lower()) for r in kept.collect())
        assert got == [(2, a), (3, b), (4, rows[3][1]), (5, "one two"), (6, "one two three"), (7, "w " * 9)]
