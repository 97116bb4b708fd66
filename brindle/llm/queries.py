"""The queries of this subpackage, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, chat, classifier, decontaminate, html_text, licenses, quality_rules, repair, secrets, sharding, simhash, spelling, warc
from brindle.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


#: Conversation -7, whose texts hold another template's control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], given.schema)
    turns = given.unionByName(probe).withColumn("parts", chat.text_part(F.col("text")))
    out = chat.format_conversations(turns)
    said = F.array_join(F.transform(chat.parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    out = out.select("conv_id", F.size(chat.parse(F.col("formatted"))).cast("long").alias("n_turns"), said.alias("said"), chat.under_loss(F.col("formatted"), F.col("loss_spans")).alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


OP2_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(role, '([<\[\\])', '\1\\', 'g') AS er, regexp_replace(text, '([<\[\\])', '\1\\', 'g') AS et FROM t
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, et) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, et), '') AS learned,
    CAST(sum(length(er) + length(et) + 23) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM g
"""


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.classes(docs, width=3, budget=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard_rows(table(spark, sf_dir, "documents"), shards=24)
    text = F.coalesce("text", F.lit("")).cast("binary")
    return dealt.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.new_folder(spark)
    index = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(index, folder, with_payload=False).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS largest FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = largest THEN NULL ELSE largest END AS refers_to
FROM g
"""


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contained(docs, items, threshold=0.8, width=5)


#: Exact containment of five-word shingles, joined as text.
OP6_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark
), item_shingles AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s
  FROM item_words WHERE len(w) > 0
), sized AS (
  SELECT item_id, count(*) AS m FROM item_shingles GROUP BY item_id
), doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), doc_shingles AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM doc_words, (SELECT DISTINCT k FROM item_shingles) WHERE len(w) >= k
)
SELECT d.doc_id, i.item_id, z.m AS n_shingles, count(*) AS n_shared, count(*) / z.m AS containment
FROM doc_shingles d JOIN item_shingles i ON d.k = i.k AND d.s = i.s JOIN sized z ON z.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, z.m HAVING 5 * count(*) >= 4 * z.m
"""


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, "text", "found").select("doc_id", "found")
    base = F.filter("found", lambda s: s["rank"] < 3)
    kind = lambda k: F.size(F.filter("found", lambda s: s["rank"] == k)).cast("long")
    return found.select(
        "doc_id",
        kind(0).alias("n_assign"),
        kind(1).alias("n_access"),
        kind(2).alias("n_hex"),
        F.sha2(secrets.digest(base), 256).alias("base_sha256"),
        secrets.digest(F.col("found")).alias("spans"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = classifier.fit(docs, labels)
    scored = classifier.score(docs, model)
    return scored.select("doc_id", classifier.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality_rules.judge(docs, "text", "q")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(f"q.{n}").alias(n) for n in names])


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizers package has a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = vocabulary_path()
    return bpe.digests(bpe.decode(bpe.encode(docs, path), path)).withColumnRenamed("id", "doc_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.count_words(docs, least=7, drop_every=31), least=7)


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults in them, by the CRC-32 of ``conv_id:turn``."""
    given = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = given.withColumn("fault", F.crc32(name.cast("binary")) % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 0, F.array().cast("array<int>")).when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return fault.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("again")).drop("again")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ordered = repair.in_order(damaged(given))
    found = repair.repairs(ordered)
    gaps = ordered.groupBy(F.col("conv_id").alias("conv")).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    parts = repair.repaired(ordered, found).where(F.size("turns") > 0).groupBy(F.col("conv_id").alias("conv")).agg(F.array_sort(F.collect_list(F.struct("part", "at", repair.lines(F.col("turns")).alias("lines")))).alias("parts"))
    said = parts.select("conv", F.sha2(F.array_join(F.col("parts.lines"), "\n"), 256).alias("repaired_sha256"))
    out = given.select("conv_id").distinct()
    for more in (gaps, found.drop("edits").withColumnRenamed("conv_id", "conv"), said):
        out = out.join(more, out["conv_id"].eqNullSafe(more["conv"]), "left").drop("conv")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan(docs, "text", "found").select("doc_id", "found")
    starts = F.col("found.places.start")
    joined = lambda c: F.array_join(c, ",")
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        joined(F.array_sort(F.array_distinct(F.col("found.places.label")))).alias("base_labels"),
        joined(licenses.labels(F.col("found"))).alias("labels"),
        licenses.score(F.col("found")).alias("score"),
    )


_Q = lambda pattern: "'" + pattern.replace("'", "''") + "'"
_FIND = lambda rank, pattern, ok: f"SELECT rid, {rank} AS rk, string_split_regex(t, {_Q(pattern)}) AS p, regexp_extract_all(t, {_Q(pattern)}) AS m, {ok} AS ok FROM d WHERE regexp_matches(t, {_Q(pattern)})"
_CANDIDATE = secrets.CANDIDATE.removesuffix("+")
_ALLOWED = " OR ".join(f"regexp_matches(s, {_Q(p)})" for p in (*secrets.ALLOW, f"^{secrets.HEX}$", f"^{secrets.ACCESS}$"))
_SHOWN = "['assign', 'access', 'hex', 'entropy'][rk + 1] || ':' || st || ':' || (st + length(s))"
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({_FIND(0, secrets.ASSIGN, f"list_transform(regexp_extract_all(t, {_Q(secrets.ASSIGN)}, 2), lambda g: length(g) >= 6)")}
  UNION ALL {_FIND(1, secrets.ACCESS, "NULL::BOOLEAN[]")} UNION ALL {_FIND(2, secrets.HEX, "NULL::BOOLEAN[]")} UNION ALL {_FIND(3, _CANDIDATE, "NULL::BOOLEAN[]")}),
x AS (SELECT rid, rk, p, m, ok, unnest(range(1, len(m) + 1)) AS i FROM f),
y AS (SELECT rid, rk, m[i] AS s, coalesce(ok[i], true) AS ok, CAST(list_sum(list_transform(p[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda v: length(v))), 0) AS BIGINT) AS st FROM x),
c AS (SELECT DISTINCT s FROM y WHERE rk = 3 AND NOT ({_ALLOWED})),
w AS (SELECT s, unnest(range(1, length(s) - {secrets.WINDOW - 2})) AS i FROM c),
n AS (SELECT s, i, ch, count(*) AS k FROM (SELECT s, i, substr(s, i + j, 1) AS ch FROM w, range(0, {secrets.WINDOW}) r(j)) GROUP BY s, i, ch),
h AS (SELECT s, max(e) AS e FROM (SELECT s, i, log2({secrets.WINDOW}) - sum(k * log2(k)) / {secrets.WINDOW} AS e FROM n GROUP BY s, i) GROUP BY s),
q AS (SELECT y.rid, y.rk, y.s, y.st FROM y LEFT JOIN h ON y.rk = 3 AND h.s = y.s WHERE y.ok AND (y.rk < 3 OR h.e >= CASE
  WHEN regexp_matches(y.s, '^[0-9a-fA-F]+$') THEN {secrets.THRESHOLDS["hex"]} WHEN regexp_matches(y.s, '^[A-Za-z0-9]+$') THEN {secrets.THRESHOLDS["alnum"]} ELSE {secrets.THRESHOLDS["base64"]} END)),
a AS (SELECT rid, count(*) FILTER (rk = 0) AS n_assign, count(*) FILTER (rk = 1) AS n_access, count(*) FILTER (rk = 2) AS n_hex,
  coalesce(string_agg({_SHOWN}, ',' ORDER BY st, rk) FILTER (rk < 3), '') AS base, string_agg({_SHOWN}, ',' ORDER BY st, rk) AS spans FROM q GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


def _strip(column: str) -> str:
    return f"trim({column}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


_COUNT = lambda text, chars: f"(length({text}) - length(translate({text}, '{chars}', '')))"
_BOILER = " OR ".join(f"contains(lower(s), {_Q(p)})" for p in quality_rules.BOILERPLATE)
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS k FROM w WHERE len(w) >= 8),
r AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
c AS (SELECT rid, CAST(sum(least(8, coalesce(nx - i, 8))) AS BIGINT) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS x FROM d),
j AS (SELECT rid, x, {_strip("x")} AS s FROM l),
k AS (SELECT rid, x, s, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n, length(s) - length(translate(s, '{quality_rules.SEPARATORS}', '')) AS bars FROM j),
v AS (SELECT rid, x, s <> '' AS worded, CASE WHEN s = '' THEN true
    WHEN n >= 4 AND NOT regexp_matches(s, '\p{{Ll}}') AND regexp_matches(s, '\p{{Lu}}') THEN false
    WHEN n < {quality_rules.SENTENCE} AND NOT regexp_matches(s, {_Q(quality_rules.SENTENCE_END)}) THEN false
    WHEN bars >= 3 AND bars * 4 >= n OR n = 1 AND regexp_matches(s, {_Q(quality_rules.ADDRESS)}) THEN false
    WHEN {_COUNT("s", quality_rules.SYMBOLS)} > n THEN false
    ELSE NOT ({_BOILER}) END AS ok FROM k),
a AS (SELECT rid, count(*) FILTER (worded) - count(DISTINCT x) FILTER (worded) AS dup, coalesce(sum(length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'))) FILTER (ok), 0) AS stay FROM v GROUP BY rid),
b AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, {_COUNT("t", quality_rules.SYMBOLS)} AS n_symbols, dup AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, stay
  FROM w JOIN a USING (rid) LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 1 - stay / nullif(word_chars, 0) <= 0.5 AS kept FROM b
"""


def queries() -> dict:
    return {
        "op1_html_text": op1_html_text,
        "op2_chat_format": op2_chat_format,
        "op3_simhash_dedup": op3_simhash_dedup,
        "op4_uniform_shards": op4_uniform_shards,
        "op5_warc": op5_warc,
        "op6_benchmark_decontamination": op6_benchmark_decontamination,
        "op7_secret_scan": op7_secret_scan,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_quality_rules": op9_quality_rules,
        "op10_bpe": op10_bpe,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_license_scan": op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": OP2_SQL, "op5_warc": OP5_SQL, "op6_benchmark_decontamination": OP6_SQL, "op7_secret_scan": OP7_SQL, "op9_quality_rules": OP9_SQL, "op11_spelling_variants": OP11_SQL, "op12_conversation_repair": OP12_SQL, "op13_license_scan": OP13_SQL}
