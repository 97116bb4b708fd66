"""Spelling variants, conversation repair and license scans against brute force."""

import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from brindle.llm import licenses, queries, repair, spelling

# ---------------------------------------------------------------- spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts, ratio=10):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form = near[0] if near and -near[0][0] >= ratio * n else None
        out[w] = [form and form[1], w, n, len(near), form and -form[0]]
    for w in out:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def words_table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def test_variants_against_all_pairs(spark, monkeypatch):
    random.seed(3)
    base = ["abcdefgh", "aaaaaaaa", "aaaaaaaab", "öäüßéèà", "abababab", "zzzzzzz"]
    counts = {}
    for _ in range(700):
        w = random.choice(base)
        for _ in range(random.randint(0, 3)):
            k = random.randint(0, len(w))
            w = random.choice((w[:k] + random.choice("abzÿ") + w[k:], w[:k] + w[k + 1 :], w[:k] + random.choice("abé") + w[k + 1 :]))
        if len(w) >= 7:
            counts[w] = random.choice((2, 3, 20, 25, 300, 3000))
    long = "xy" * 3000
    counts |= {long: 2, long[1:]: 40, "q" * 7: 1}
    some = {w: n for w, n in counts.items() if n >= 2}
    for leaf, most in ((64, 20_000), (2, 5)):
        monkeypatch.setattr(spelling, "LEAF", leaf)
        whole = spelling.near_words
        monkeypatch.setattr(spelling, "near_words", lambda w, least, most=most, whole=whole: whole(w, least, most))
        got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(words_table(spark, counts)).collect()}
        monkeypatch.setattr(spelling, "near_words", whole)
        assert got == brute_variants(some)


def test_variants_of_a_chain_and_ties(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefgx": 20, "abcdefgz": 20}
    got = {r.word: (r.form, r.root) for r in spelling.variants(words_table(spark, counts)).collect()}
    assert got["abcdefg"] == ("abcdefgh", "abcdefghij") and got["abcdefghij"] == (None, "abcdefghij")


def test_heap_merge_counts_and_limits():
    assert list(spelling.merged([[1, 3, 5], [3, 5], [5, 7]], 2)) == [3, 5]
    assert list(spelling.merged([[1, 3], [3]], 1)) == [1, 3] and list(spelling.merged([[1]], 2)) == []
    assert spelling.edit_place("aab", "aaab") == 0 and spelling.edit_place("abc", "abd") == 2 and spelling.edit_place("abc", "abc") is None


def test_counted_words(spark):
    run = re.compile("[A-Za-zÀ-ÿ]+")
    rows = [(i, "Somewhat DIFFERENT wordings, ÉTRANGES wordings×here and somewhat_else " * (i % 4)) for i in range(60)] + [(None, "somewhat wordings"), (7, None), (7, "somewhat"), (7, "somewhat")]
    expected = {}
    for i, t in rows:
        for w in run.findall(t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                expected[w] = expected.get(w, 0) + 1
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    assert {r.word: r.n for r in spelling.count_words(df, drop_every=31).collect()} == expected
    assert spelling.variants(spelling.count_words(df.limit(0))).count() == 0


# ---------------------------------------------------------------- repair


def brute_repair(rows):
    """The least (cost, audit) and what it gives, over all edits; ``rows``:
    (role, text, fault) in order."""
    pattern = re.compile("(s?(ua)+)?")
    best = 4 * len(rows), "D" * len(rows), ""

    def extend(k, cost, audit, out, inserted):
        nonlocal best
        if cost > best[0]:
            return
        if k == len(rows) and pattern.fullmatch("".join(r[:1] or " " for r, _ in out)):
            weight = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
            best = min(best, weight)
        if inserted < 2:
            for role in ("user", "assistant"):
                extend(k, cost + 3, audit + "I", [*out, (role, "")], inserted + 1)
        if k < len(rows):
            role, text, fault = rows[k]
            extend(k + 1, cost + 4, audit + "D", out, 0)
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                extend(k + 1, cost + more, audit + "K", [*out, (role, text)], 0)
                for new in ("user", "assistant"):
                    extend(k + 1, cost + 3 + more, audit + "R", [*out, (new, text)], 0)

    extend(0, 0, "", [], 0)
    return best


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None))
        seen.add((role, text))
    return out


def repaired(spark, rows, parts):
    """By the operator, with so many parts."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit(1)).withColumn("key", F.lit("x"))
        ordered = repair.in_order(df)
        found = repair.repairs(ordered)
        out = {r.conv_id: r for r in found.collect()}
        said = {}
        for r in repair.repaired(ordered, found).where("size(turns) > 0").orderBy("part", "at").select("conv_id", repair.lines(F.col("turns")).alias("x")).collect():
            said.setdefault(r.conv_id, []).append(r.x)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return {c: (r.cost, r.audit, "\n".join(said.get(c, []))) for c, r in out.items()}, out


def test_repair_against_all_edits(spark):
    random.seed(5)
    rows = []
    for conv in range(60):
        for turn in range(random.randint(1, 4)):
            rows.append((conv, turn, random.choice(("system", "user", "assistant", "tool", "")), random.choice(("a.", "b!", "c", " ", "", f"{turn}?", "d. \t"))))
    for parts in (1, 7):
        got, full = repaired(spark, rows, parts)
        for conv in range(60):
            own = [(r, t) for c, _, r, t in rows if c == conv]
            assert got[conv] == brute_repair(faults(own)), own
            pairs = [x[:1] + y[:1] for (x, _), (y, _) in zip(own, own[1:], strict=False)]
            assert full[conv].illegal == sum(p not in ("su", "ua", "au") for p in pairs)


def test_repair_of_a_long_conversation_in_parts(spark):
    random.seed(6)
    rows = [(1, k // 2 if k % 5 else None, random.choice(("user", "assistant", "system", "tool")), f"{random.choice(('x', 'y', ''))}{k % 700}{random.choice(('.', ''))}") for k in range(4000)]
    rows += [(None, None, None, None), (None, 1, "user", "hm?"), (2, 5, "user", "a."), (2, 5, "user", "a.")]
    one, _ = repaired(spark, rows, 1)
    many, full = repaired(spark, rows, 9)
    assert one == many and len({e.part for e in full[1].edits}) > 2
    assert one[2] == (7, "KID"[:0] + one[2][1], "user:a.\nassistant:") and one[2][1] == "KDI"
    assert one[None] == (7, "DKI", "user:hm?\nassistant:")


def test_paths_compare_whole_strings():
    for symbols in product((("u", None), ("a", "truncated"), ("s", None), ("u", "blank")), repeat=3):
        best = {}

        def walk(k, state, cost, labels, symbols=symbols, best=best):
            if k == len(symbols):
                best[state] = min(best.get(state, (cost, labels)), (cost, labels))
                return
            for then, more, x in repair.arcs(state, *symbols[k]):
                walk(k + 1, then, cost + more, labels + x)

        walk(0, 0, 0, "")
        assert repair.paths(list(symbols), 0) == best


def by_sql(name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        frame = rows.toPandas() if hasattr(rows, "toPandas") else rows  # noqa: F841
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM frame")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    return sorted(map(str, ({n: v for n, v in sorted(zip(names, r, strict=True))} for r in cur.fetchall())))


def test_damage_and_digest_of_odd_rows(spark, tmp_path):
    rows = [(c, t, r, x) for c in range(60) for t, (r, x) in enumerate([("system", "Be.\n"), ("user", "Why?"), ("assistant", "So it is!"), ("user", "So"), (None, None), ("assistant", "é.")])]
    rows += [(None, None, None, None), (None, 3, "user", "a."), (900, None, "user", "x."), (900, -5, "user", "x."), (900, -5, "assistant", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit("clash"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, f"file://{tmp_path}")
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    cur = con.execute(queries.oracle_sql()["op12_conversation_repair"])
    at = [[d[0] for d in cur.description].index(n) for n in names]
    assert sorted(str(tuple(r[n] for n in names)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in cur.fetchall())
    assert got.count() == 62
    assert all(r.audit or r.repaired_sha256 == hashlib.sha256(b"").hexdigest() for r in got.collect())


# ---------------------------------------------------------------- licenses


def brute_licenses(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = sorted((i, label) for label, p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    blocks = set()
    for number, (label, t) in enumerate(licenses.TEMPLATES):
        parts = re.findall("[a-z0-9]+", t.lower())
        size = min(c for c in licenses.CLASSES if c >= len(parts))
        for i in range(0, len(words), size):
            share = len(set(parts) & set(words[i : i + 2 * size])) / len(set(parts))
            if share >= licenses.THRESHOLD:
                blocks.add((label, number, i, share))
    return len(words), places, blocks


def test_licenses_against_all_blocks(spark):
    random.seed(8)
    words = sorted({w for _, t in licenses.TEMPLATES for w in t.split()})
    texts = [None, "", "...", "Under the MIT License under the mit-license UNDER THE mit license", "under the mit", "Ünder the mit license", "apache LICENSE, version 2.0 cc\nby\nnc"]
    for label, t in licenses.TEMPLATES:
        own = t.split()
        texts += [t, "lorem ipsum " * 50 + t.upper() + " dolor" * 77, "\n".join(own), " ".join(w for w in own if random.random() < 0.85), " ".join(random.sample(own, len(own))), f"{label} {' '.join(own[: len(own) * 4 // 5])}"]
    texts += [" ".join(random.choices(words, k=random.randint(1, 400))) for _ in range(60)] + ["word " * 100_000 + "All rights reserved."]
    df = spark.createDataFrame([(k % 50, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("label", F.lit("a")).withColumn("held", F.lit("b"))
    got = licenses.scan(df).collect()
    assert len(got) == len(texts)
    for t, r in zip(texts, got, strict=True):
        x = r.licenses
        n, places, blocks = brute_licenses(t)
        assert (x.n_words, [(p.start, p.label) for p in x.places]) == (n, places)
        assert sorted((b.label, b.template, b.start, b.containment) for b in x.blocks) == sorted(blocks)
    found = licenses.scan(df, result_column="f").select(licenses.labels(F.col("f")).alias("x"), licenses.score(F.col("f")).alias("s")).collect()
    assert found[0].x == [] and found[0].s == 0 and found[3].x == ["mit"] and found[3].s == 1
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="already"):
        licenses.scan(df, result_column="label")


def test_license_words_are_ordered_by_frequency(spark):
    df = spark.createDataFrame([("the license",), ("the mit",), ("the",), (None,)], "text string")
    order = licenses.by_frequency(df)
    assert order[-1] == "the" and set(order[-3:]) == {"the", "license", "mit"} and set(order) == set(licenses.vocabulary())
