"""Text operators over responses made from the documents' numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.plans.common import rounded, sql_rounded
from brindle.sources import fixtures as X

QUERIES, ORACLES = {}, {}


def responses(spark, sf_dir):
    """doc_id, response: marked steps (or, each 7th, paragraphs), then an
    answer line (each 5th without) and a confidence line."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(14)).cast("int").alias("n"))
    marked = F.concat_ws("\n", F.transform(F.sequence(F.lit(1), F.col("n") + 1), lambda i: F.concat(F.when(i % 2 == 0, "Reasoning").otherwise("reasoning"), F.lit(" step "), i.cast("string"), F.lit(":  item "), (F.col("doc_id") * i).cast("string"), F.lit(" "))))
    plain = F.concat_ws("\n \n", F.transform(F.sequence(F.lit(1), F.col("n") + 1), lambda i: F.concat(F.lit(" part "), i.cast("string"))))
    body = F.when(F.col("doc_id") % 7 == 0, plain).otherwise(marked)
    letter = F.substring(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1))
    answer = F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("\n**Final answer:** D or rather\nfinal answer ("), letter, F.lit(")")))
    sure = F.concat(F.lit("\n confidence: "), (F.col("doc_id") % 150 / 100).cast("string"), F.lit(" "))
    return d.select("doc_id", F.concat(body, answer).alias("response"), F.concat(body, answer, sure).alias("with_confidence"))


RESPONSES = r"""rs AS (
  SELECT doc_id, CASE WHEN doc_id % 7 = 0
      THEN list_aggregate(list_transform(range(1, doc_id % 14 + 2), lambda i: ' part ' || i), 'string_agg', chr(10) || ' ' || chr(10))
      ELSE list_aggregate(list_transform(range(1, doc_id % 14 + 2), lambda i: CASE WHEN i % 2 = 0 THEN 'Reasoning' ELSE 'reasoning' END || ' step ' || i || ':  item ' || (doc_id * i) || ' '), 'string_agg', chr(10)) END AS body,
    CASE WHEN doc_id % 5 = 0 THEN '' ELSE chr(10) || '**Final answer:** D or rather' || chr(10) || 'final answer (' || substr('ABCD', doc_id % 4 + 1, 1) || ')' END AS answer,
    doc_id % 150 / 100.0::DOUBLE AS conf
  FROM documents
)"""


def decompose(spark, sf_dir):
    out = responses(spark, sf_dir).select("doc_id", T.decompose(F.col("response")).alias("d"))
    return out.select("doc_id", F.array_join("d.steps", "|").alias("steps"), F.col("d.answer").alias("answer"), F.col("d.n_raw").alias("n_raw"), F.col("d.used_fallback").alias("used_fallback"))


QUERIES["decompose"] = decompose
ORACLES["decompose"] = f"""WITH {RESPONSES}, sp AS (
  SELECT doc_id, answer, regexp_extract_all(body || answer, '(?i)^reasoning step (\\d+):\\s*(.*)$', 2, 'm') AS marked, doc_id % 7 = 0 AS fb, doc_id % 14 + 1 AS n FROM rs),
al AS (SELECT doc_id, answer, fb, n, CASE WHEN fb THEN list_transform(range(1, n + 1), lambda i: 'part ' || i) ELSE list_transform(range(1, n + 1), lambda i: 'item ' || (doc_id * i)) END AS st FROM sp),
tail AS (SELECT doc_id, answer, fb, n, CASE WHEN fb AND answer <> '' THEN list_concat(st[1:n - 1], [st[n] || chr(10) || ' or rather)']) ELSE st END AS st FROM al)
SELECT doc_id, array_to_string(CASE WHEN n <= 10 THEN st ELSE list_transform(range(0, 10), lambda i: st[CAST(round_even(i * (n - 1) / 9.0::DOUBLE, 0) AS INT) + 1]) END, '|') AS steps,
  CASE WHEN answer <> '' THEN substr('ABCD', doc_id % 4 + 1, 1) END AS answer, n AS n_raw, fb AS used_fallback FROM tail"""


def parse_confidence(spark, sf_dir):
    return responses(spark, sf_dir).select("doc_id", rounded(T.parse_confidence(F.col("with_confidence")), "confidence"))


QUERIES["parse_confidence"] = parse_confidence
ORACLES["parse_confidence"] = f"WITH {RESPONSES} SELECT doc_id, {sql_rounded('CASE WHEN conf <= 1 THEN conf END', 'confidence')} FROM rs"


def extract_letter(spark, sf_dir):
    r = responses(spark, sf_dir)
    said = F.concat(F.col("response"), F.when(F.col("doc_id") % 3 == 0, F.lit("\nso E or B it is")).otherwise(""))
    return r.select("doc_id", T.extract_letter(said, F.array(*map(F.lit, "ABCD"))).alias("letter"))


QUERIES["extract_letter"] = extract_letter
ORACLES["extract_letter"] = f"WITH {RESPONSES} SELECT doc_id, CASE WHEN answer <> '' THEN substr('ABCD', doc_id % 4 + 1, 1) WHEN doc_id % 3 = 0 THEN 'B' END AS letter FROM rs"


def downsample(spark, sf_dir):
    """Ten even places of the lines of each supplier."""
    n = X.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").cast("int").alias("n"))
    return n.select("l_suppkey", "n", F.array_join(T.even_places(F.col("n"), 10), ",").alias("places"))


QUERIES["downsample"] = downsample
ORACLES["downsample"] = "SELECT l_suppkey, CAST(n AS INT) AS n, array_to_string(CASE WHEN n <= 10 THEN range(0, n) ELSE list_transform(range(0, 10), lambda i: CAST(round_even(i * (n - 1) / 9.0::DOUBLE, 0) AS BIGINT)) END, ',') AS places FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)"


def questions(spark, sf_dir):
    """benchmark items as questions with three choices."""
    b = X.table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.create_map(F.lit("B"), F.concat(F.lit("b"), F.col("item_id").cast("string")), F.lit("A"), F.lit("first"), F.lit("C"), F.substring("text", 1, 5)).alias("choices"))


def question_hash(spark, sf_dir):
    q = questions(spark, sf_dir)
    return q.select("question_id", T.question_hash(F.col("question"), F.col("choices")).alias("node_id"), T.question_hash(F.col("question"), F.col("choices"), F.col("question_id").cast("string")).alias("with_id"))


QUERIES["question_hash"] = question_hash
_HASH = "'q:' || text || chr(0) || 'choices:A=first' || chr(0) || 'B=b' || item_id || chr(0) || 'C=' || substr(text, 1, 5) || chr(0)"
ORACLES["question_hash"] = f"SELECT item_id AS question_id, sha256({_HASH}) AS node_id, sha256('qid:' || item_id || chr(0) || {_HASH}) AS with_id FROM benchmark"

TEMPLATE = "Q: {question}\n{choices}\n{reasoning_so_far}Answer:"


def fmt_prompt(spark, sf_dir):
    q = questions(spark, sf_dir)
    return q.select("question_id", T.fill("Q: {question}\n{choices}", question=F.col("question"), choices=T.format_choices(F.col("choices"))).alias("prompt"))


QUERIES["fmt_prompt"] = fmt_prompt
ORACLES["fmt_prompt"] = "SELECT item_id AS question_id, 'Q: ' || text || chr(10) || 'A. first' || chr(10) || 'B. b' || item_id || chr(10) || 'C. ' || substr(text, 1, 5) AS prompt FROM benchmark"


def prefix_prompts(spark, sf_dir):
    q = questions(spark, sf_dir)
    steps = F.transform(F.sequence(F.lit(1), F.pmod("question_id", F.lit(3)).cast("int") + 1), lambda i: F.concat(F.lit("s"), i.cast("string")))
    prompts = T.prefix_prompts(TEMPLATE, F.col("question"), F.col("choices"), steps)
    return q.select("question_id", F.posexplode(prompts).alias("timestep", "prompt"))


QUERIES["prefix_prompts"] = prefix_prompts
ORACLES["prefix_prompts"] = """SELECT item_id AS question_id, CAST(k AS INTEGER) AS timestep, 'Q: ' || text || chr(10) || 'A. first' || chr(10) || 'B. b' || item_id || chr(10) || 'C. ' || substr(text, 1, 5) || chr(10)
  || coalesce((SELECT string_agg('Reasoning step ' || i || ': s' || i || chr(10), '' ORDER BY i) FROM range(1, k + 1) t(i)), '') || 'Answer:' AS prompt
FROM benchmark, range(0, 4) r(k) WHERE k <= item_id % 3 + 1"""


def lcp(spark, sf_dir):
    """Longest common prefix of two documents' words, by neighbouring ids."""
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    a, b = d.select(F.floor(F.col("doc_id") / 2).alias("pair"), "w").where("doc_id % 2 = 0"), d.select(F.floor(F.col("doc_id") / 2).alias("pair"), F.col("w").alias("v")).where("doc_id % 2 = 1")
    return a.join(b, "pair").select("pair", T.common_prefix(F.array("w", "v")).alias("n"))


QUERIES["lcp"] = lcp
ORACLES["lcp"] = """WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), p AS (SELECT a.doc_id // 2 AS pair, a.w AS w, b.w AS v FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0)
SELECT pair, CAST(coalesce(list_min(list_filter(range(1, least(len(w), len(v)) + 1), lambda i: w[i] <> v[i])) - 1, least(len(w), len(v))) AS INTEGER) AS n FROM p"""


def explore(spark, sf_dir):
    """Profile: texts, languages, exact length quantiles."""
    d = X.table(spark, sf_dir, "documents").select("lang", F.char_length("text").alias("n"))
    from brindle.operators.ordered import quantiles

    stats = d.groupBy("lang").agg(F.count("*").alias("docs"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"))
    return stats.join(quantiles(d, ["lang"], "n", {"median": 0.5}), "lang").select("lang", "docs", "least", "most", rounded("mean"), rounded("median"))


QUERIES["explore"] = explore
ORACLES["explore"] = f"SELECT lang, count(*) AS docs, min(length(text)) AS least, max(length(text)) AS most, {sql_rounded('avg(length(text))', 'mean')}, {sql_rounded('quantile_cont(length(text), 0.5)', 'median')} FROM documents GROUP BY lang"


def prompt_versions(spark, sf_dir):
    """Prompts with a version header as versions and bodies."""
    raw = F.concat(F.lit("\n# version: "), (F.col("item_id") % 7 + 1).cast("string"), F.lit(" of it\nBody "), "text")
    return X.table(spark, sf_dir, "benchmark").select("item_id", T.prompt_version(raw).alias("version"), T.prompt_body(raw).alias("body"))


QUERIES["prompt_versions"] = prompt_versions
ORACLES["prompt_versions"] = "SELECT item_id, CAST(item_id % 7 + 1 AS INTEGER) AS version, 'Body ' || text AS body FROM benchmark"
