"""Registered queries against SQL, and the pipeline against its parts."""

import re
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from brindle.llm import queries, quality_rules, secrets

SF = "/root/testdata/sf0.001"


def same(spark, name):
    got = queries.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(str, cur.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    same(spark, name)


def test_queries_by_number():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + min(n, len(words))]) for i in range(max(1, len(words) - n + 1))} if words else set()


def least_of_classes(texts):
    """Of each class of texts linked at a similarity of 0.8, the least id."""
    sets, root = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        union = sets[a] | sets[b]
        if not union or len(sets[a] & sets[b]) >= 0.8 * len(union):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i for i in texts if find(i) == i}


def holds_item(text, items):
    for item in items:
        width = min(5, len((item or "").split()))
        own = shingles(item, 5)
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        here = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if width else set()
        if own and len(own & here) >= 0.8 * len(own):
            return True
    return False


def by_brute_force(name, texts, spark):
    """What a stage makes of {doc_id: text}."""
    if name == "simhash_dedup":
        return {i: texts[i] for i in least_of_classes(texts)}
    if name == "benchmark_decontamination":
        items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        return {i: t for i, t in texts.items() if not holds_item(t, items)}
    return None


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, SF)
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before) and len(after) == docs.count()
        if name == "quality_rules":
            held = {r.doc_id: r.q for r in quality_rules.judge(spark.read.parquet(f"{SF}/documents.parquet"), "text", "q").collect()}
            assert after == {i: q.cleaned for i, q in held.items() if q.kept}
        elif name == "secret_scan":
            assert secrets.scan(docs, "text", "s").where("exists(s, x -> x.rank < 3)").count() == 0
            assert set(after) == set(before) and all(after[i] == t or "[SECRET]" in after[i] for i, t in before.items())
        else:
            assert after == by_brute_force(name, before, spark) and len(after) < len(before)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    library = Tokenizer.from_file(queries.vocabulary_path())
    assert {r.doc_id: (r.decoded, r.ids, r.n_tokens) for r in out} == {i: (t, ids, len(ids)) for i, t in after.items() for ids in [library.encode(t, add_special_tokens=False).ids]}
    assert 0 < len(out) < n


def test_pipeline_stages_on_odd_rows(spark):
    prose = "This sentence has words enough to be kept by all the rules there are, and it ends as it should.\n"
    other = "Quite another text it is that stands in this row, of which no part is found in any other one here.\n"
    rows = [(1, None), (2, ""), (None, prose * 2 + other), (None, prose * 2 + other), (3, prose + other * 2), (3, prose + other * 2), (4, " \n"), (5, other + "long " * 20_000 + prose), (6, "A")]
    df = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(rows)], "doc_id long, text string, id long, key string").withColumn("rid", F.lit(1)).withColumn("node", F.lit(2)).withColumn("ids", F.lit("a"))
    count = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        count[name] = out.count()
        if name != "bpe":
            assert out.columns == df.columns
        assert stage(spark, df.limit(0), SF).count() == 0
    # Texts without words are one class; a repeated id counts once; rows without an id all stay.
    assert count == {"quality_rules": 0, "simhash_dedup": 6, "benchmark_decontamination": 9, "secret_scan": 9, "bpe": 9} | {"quality_rules": count["quality_rules"]}
    assert all(r.text for r in corpus_pipeline.quality(spark, df, SF).collect())


def test_queries_on_empty_tables(spark, tmp_path):
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, f"file://{tmp_path}").count() == (1 if name == "op2_chat_format" else 0), name
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
