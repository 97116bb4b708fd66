"""Measurement runs with a scripted model whose replies depend on the prompt,
and the whole score table."""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.operators import conditions as C
from brindle.operators import measure as M
from brindle.operators import evaluate, signatures, trajectory
from brindle.operators.ordered import rank_percentiles
from brindle.plans.common import rounded, sql_rounded
from brindle.plans.evaluation import auc_sql
from brindle.plans.graph import KNN, VOI, _graph
from brindle.plans.scores import PER_TRAJECTORY, _rp
from brindle.plans.text import questions
from brindle.sources import fixtures as X
from brindle.sources.questions import subject_questions
from brindle.sources.store import cut_lineage

QUERIES, ORACLES = {}, {}


class DigestModel:
    """Replies made of the prompt's MD5 digits, which SQL can follow: one in
    sixteen is blank and one has neither steps nor an answer; the others have
    steps, an answer and a confidence.
    At a temperature the seed counts as part of the prompt."""

    def generate(self, prompt, max_tokens=None, temperature=0.0, seed=None):
        asked = prompt if temperature <= 0 else f"{prompt}#{seed}"
        text = hashlib.md5(asked.encode()).hexdigest()
        d = [int(x, 16) for x in text]
        if d[0] >= 14:
            return "hm" if d[0] == 14 else " "
        steps = "".join(f"Reasoning step {i}: s{text[3:5]}{i}\n" for i in range(1, 3 + d[2] % 3))
        return f"{steps}Final answer: {'ABC'[d[1] % 3]}\nConfidence: {d[5] / 16}"

    def top_logprobs(self, prompt, k):
        weights = [1 + int(x, 16) for x in hashlib.md5(prompt.encode()).hexdigest()[:3]]
        return {t: math.log(0.9 * w / sum(weights)) for t, w in zip("ABC", weights, strict=True)}

    def metadata(self):
        return {"adapter_name": "DigestModel", "model": "md5"}


def _questions(spark, sf_dir):
    return questions(spark, sf_dir).withColumn("question_id", F.col("question_id").cast("string"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _filled(name: str, **fields: str) -> str:
    """A template as an SQL expression."""
    parts = re.split(r"\{(\w+)\}", C.template(name))
    return " || ".join(fields[p] if k % 2 else _quoted(p) for k, p in enumerate(parts))


def _digit(text: str, k: int) -> str:
    return f"(strpos('0123456789abcdef', substr(md5({text}), {k + 1}, 1)) - 1)"


_CHOICES = "'A. first' || chr(10) || 'B. b' || item_id || chr(10) || 'C. ' || substr(text, 1, 5)"
_TEXT = "'q:' || text || chr(0) || 'choices:A=first' || chr(0) || 'B=b' || item_id || chr(0) || 'C=' || substr(text, 1, 5) || chr(0)"


def _asked_sql(name: str, least: int = 14) -> str:
    """Common tables: fp, the prompt whose reply counts, and whether it can be
    read; the first digit is ``least`` or more where not."""
    return f"""a AS (SELECT CAST(item_id AS VARCHAR) AS question_id, item_id, text, {_filled(name, question='text', choices=_CHOICES)} AS p FROM benchmark),
r AS (SELECT *, {_digit('p', 0)} >= {least} AS again, CASE WHEN {_digit('p', 0)} >= {least} THEN {_filled('repair', prompt='p', reply=f"CASE WHEN {_digit('p', 0)} = 14 THEN 'hm' ELSE ' ' END")} ELSE p END AS fp FROM a),
f AS (SELECT *, {_digit('fp', 0)} < {least} AS ok, {_digit('fp', 0)} = 14 AS hm FROM r)"""


RESULT = ("question_id", "condition_id", "predicted_answer", "deferral_signal", "success", "n_calls", "repair_attempts")


def _answers_sql(condition: str, signal: str) -> str:
    return f"""SELECT question_id, '{condition}' AS condition_id, CASE WHEN ok THEN substr('ABC', {_digit('fp', 1)} % 3 + 1, 1) END AS predicted_answer, {signal} AS deferral_signal, ok AS success,
  CASE WHEN again THEN 2 ELSE 1 END AS n_calls, CASE WHEN again THEN 1 ELSE 0 END AS repair_attempts FROM f"""


_SIGNAL_B = f"CASE WHEN ok THEN 1 - {_digit('fp', 5)} / 16.0::DOUBLE ELSE 0.5::DOUBLE END"
QUERIES["cond_a"] = lambda s, d: C.condition_a(_questions(s, d), DigestModel).select(*RESULT)
ORACLES["cond_a"] = f"WITH {_asked_sql('condition_a')} {_answers_sql('A', '0.5::DOUBLE')}"
QUERIES["cond_b"] = lambda s, d: C.condition_b(_questions(s, d), DigestModel).select(*RESULT)
ORACLES["cond_b"] = f"WITH {_asked_sql('condition_b')} {_answers_sql('B', _SIGNAL_B)}"

_STEP = "CASE WHEN hm THEN 'hm' ELSE 's' || substr(md5(fp), 4, 2) || {} END"
_SO_FAR = f"coalesce((SELECT string_agg('Reasoning step ' || i || ': ' || {_STEP.format('i')} || chr(10), '' ORDER BY i) FROM range(1, k + 1) t(i)), '')"
_STATES_SQL = f"""{_asked_sql('condition_c_initial', 15)},
n AS (SELECT *, CASE WHEN hm THEN 1 WHEN ok THEN 2 + {_digit('fp', 2)} % 3 ELSE 0 END AS n FROM f),
m AS (SELECT *, {_filled('condition_c_measurement', question='text', choices=_CHOICES, reasoning_so_far=_SO_FAR)} AS mp FROM n, range(0, 5) s(k) WHERE k <= n),
w AS (SELECT *, 1 + {_digit('mp', 0)} AS wa, 1 + {_digit('mp', 1)} AS wb, 1 + {_digit('mp', 2)} AS wc FROM m)"""


def cond_c(spark, sf_dir):
    _, states = C.condition_c(_questions(spark, sf_dir), DigestModel, ["A", "B", "C"])
    p = F.col("distribution")["A"]
    return states.select("trajectory_id", "position", "node_id", "step_text", rounded(p, "p_a"), rounded("mass_capture"), F.size("truncated").alias("n_truncated"), F.col("action_metadata.step_text_len").alias("next_len"), F.col("metadata.failure_reason").alias("failure"))


QUERIES["cond_c"] = cond_c
ORACLES["cond_c"] = f"""WITH {_STATES_SQL} SELECT question_id AS trajectory_id, CAST(k AS INTEGER) AS position, CASE WHEN k = 0 THEN sha256({_TEXT}) ELSE sha256({_TEXT} || mp) END AS node_id, CASE WHEN k > 0 THEN {_STEP.format('k')} END AS step_text,
  {sql_rounded('CASE WHEN ok THEN wa::DOUBLE / (wa + wb + wc) END', 'p_a')}, {sql_rounded('CASE WHEN ok THEN 0.9::DOUBLE END', 'mass_capture')}, CASE WHEN ok THEN 0 END AS n_truncated, CASE WHEN k < n THEN CASE WHEN hm THEN 2 ELSE 4 END END AS next_len, CASE WHEN NOT ok THEN 'no steps in the response' END AS failure FROM w"""


def cond_c_results(spark, sf_dir):
    results, _ = C.condition_c(_questions(spark, sf_dir), DigestModel, ["A", "B", "C"], embedder=M.HashEmbedder)
    return results.select("question_id", "predicted_answer", "success", "n_calls", "repair_attempts", "n_steps_raw", "n_truncated")


QUERIES["cond_c_results"] = cond_c_results
ORACLES["cond_c_results"] = f"""WITH {_STATES_SQL} SELECT question_id, CASE WHEN ok THEN CASE WHEN wa >= wb AND wa >= wc THEN 'A' WHEN wb >= wc THEN 'B' ELSE 'C' END END AS predicted_answer, ok AS success,
  CASE WHEN again THEN 2 ELSE 1 END + CASE WHEN ok THEN 1 ELSE 0 END AS n_calls, CASE WHEN again THEN 1 ELSE 0 END AS repair_attempts, CAST(n AS INTEGER) AS n_steps_raw, CASE WHEN ok THEN 0 END AS n_truncated FROM w WHERE k = n"""


def lean_capture(spark, sf_dir):
    asked = _questions(spark, sf_dir).withColumn("answer_letter", F.lit("B"))
    _, states = C.condition_c(asked, DigestModel, ["A", "B", "C"])
    found = C.lean_capture(states, asked, ["A", "B", "C"])
    return found.select("question_id", "gold", "pred", "n_steps", F.posexplode("ent").alias("position", "ent"), "entfull", "varent").select("question_id", "gold", "pred", "n_steps", "position", rounded("ent"), rounded(F.get("entfull", "position"), "entfull"), rounded(F.get("varent", "position"), "varent"))


QUERIES["lean_capture"] = lean_capture
_P = "list_transform([wa, wb, wc], lambda x: x::DOUBLE / (wa + wb + wc))"
ORACLES["lean_capture"] = f"""WITH {_STATES_SQL}, e AS (SELECT *, -list_sum(list_transform({_P}, lambda x: x * ln(x))) AS h, list_sum(list_transform({_P}, lambda x: x * ln(x) * ln(x))) AS h2 FROM w WHERE ok)
SELECT question_id, 'B' AS gold, (SELECT CASE WHEN v.wa >= v.wb AND v.wa >= v.wc THEN 'A' WHEN v.wb >= v.wc THEN 'B' ELSE 'C' END FROM w v WHERE v.question_id = e.question_id AND v.k = e.n) AS pred, CAST(n + 1 AS INTEGER) AS n_steps, CAST(k AS INTEGER) AS position, {sql_rounded('h / ln(2)', 'ent')}, {sql_rounded('h', 'entfull')}, {sql_rounded('h2 - h * h', 'varent')} FROM e"""


def semantic_entropy(spark, sf_dir):
    """Six seeded samples a question; unreadable ones are read by the belief
    after them."""
    asked = _questions(spark, sf_dir).withColumn("prompt", T.fill("{question}\n{choices}\nReason, then answer.\n", question=F.col("question"), choices=T.format_choices(F.col("choices"))))
    return M.semantic_entropy(asked, DigestModel, ["A", "B", "C"]).select("question_id", rounded("semantic_entropy"), "n_valid_samples", "n_forced")


QUERIES["semantic_entropy"] = semantic_entropy
ORACLES["semantic_entropy"] = f"""WITH a AS (SELECT CAST(item_id AS VARCHAR) AS question_id, text || chr(10) || {_CHOICES} || chr(10) || 'Reason, then answer.' || chr(10) AS p FROM benchmark),
s AS (SELECT question_id, p || '#' || seed AS sp, p || 'hm' || chr(10) || 'Answer:' AS fp FROM a, range(42, 48) t(seed)),
w AS (SELECT *, {_digit('sp', 0)} = 14 AS forced, {_digit('fp', 0)} AS wa, {_digit('fp', 1)} AS wb, {_digit('fp', 2)} AS wc FROM s WHERE {_digit('sp', 0)} < 15),
l AS (SELECT question_id, forced, CASE WHEN NOT forced THEN substr('ABC', {_digit('sp', 1)} % 3 + 1, 1) WHEN wa >= wb AND wa >= wc THEN 'A' WHEN wb >= wc THEN 'B' ELSE 'C' END AS letter FROM w),
c AS (SELECT question_id, letter, count(*) AS c, count(*) FILTER (forced) AS f FROM l GROUP BY ALL)
SELECT question_id, {sql_rounded('greatest(0, log2(sum(c)) - sum(c * log2(c)) / sum(c))', 'semantic_entropy')}, CAST(sum(c) AS BIGINT) AS n_valid_samples, CAST(sum(f) AS BIGINT) AS n_forced FROM c GROUP BY question_id"""


def embed(spark, sf_dir):
    items = X.table(spark, sf_dir, "benchmark")
    rows = M.action_hash(M.embed(items, M.HashEmbedder), name="action_id")
    return rows.select("item_id", F.size("embedding").alias("dimension"), "action_id")


QUERIES["embed"] = embed


def src_mmlu(spark, sf_dir):
    """Subject questions made of parts: four choices, answer by number."""
    p = X.table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").alias("row_index"), F.col("p_brand").alias("subject"), F.col("p_name").alias("question"), F.array("p_name", "p_type", "p_brand", F.lit("none")).alias("choices"), F.pmod("p_size", F.lit(4)).cast("int").alias("answer"))
    return subject_questions(rows, "Brand#11", "test").select("question_id", "question", F.col("choices")["B"].alias("b"), "answer_letter")


QUERIES["src_mmlu"] = src_mmlu
ORACLES["src_mmlu"] = "SELECT 'mmlu-Brand#11-test-' || p_partkey AS question_id, p_name AS question, p_type AS b, substr('ABCD', p_size % 4 + 1, 1) AS answer_letter FROM part WHERE p_brand = 'Brand#11'"


def _logits(s):
    return s.where("distribution is not null").select("trajectory_id", "position", F.array(*[F.ln(F.col("distribution")[x] + 0.001) for x in X.SPACE]).alias("logits"))


def sample_token(spark, sf_dir):
    """The likeliest token; draws are held against their law by tests."""
    return M.sample_token(_logits(X.states(spark, sf_dir)), "logits", ["trajectory_id", "position"]).select("trajectory_id", "position", F.col("token").cast("long").alias("token"))


QUERIES["sample_token"] = sample_token
ORACLES["sample_token"] = f"WITH {X.STATES} SELECT trajectory_id, position, CAST(list_position(dist, list_max(dist)) - 1 AS BIGINT) AS token FROM states WHERE dist IS NOT NULL"


def _signed(states, spark, sf_dir):
    steps = X.transitions(spark, sf_dir)
    _, edges = _graph(spark, sf_dir)
    v = X.visits(spark, sf_dir)
    found = signatures.compute_signatures(states, steps, edges, v.withColumn("trajectory_id", F.pmod("visit_seq", F.lit(50))), v)
    return found.select("trajectory_id", *[rounded(F.col(c).cast("double"), c) for c in found.columns[1:]])


def compute_signatures(spark, sf_dir):
    return _signed(X.states(spark, sf_dir), spark, sf_dir)


QUERIES["compute_signatures"] = compute_signatures
_FLOAT = lambda e, name: sql_rounded(f"CAST(CAST({e} AS FLOAT) AS DOUBLE)", name)
SIGNATURES = f"""{PER_TRAJECTORY}, {VOI.lstrip()}, ge AS (SELECT source_id, action_id, target_id, abs(voi) AS gain FROM ed JOIN kl USING (source_id, action_id)),
vf AS (SELECT trajectory_id, coalesce(avg(CASE WHEN ad.target_id IS NOT NULL THEN coalesce(gain, (SELECT max(gain) FROM ge)) END), 0) AS voi_flatness FROM ad LEFT JOIN ge USING (source_id, action_id, target_id) GROUP BY 1),
{KNN}, ds AS (SELECT query_seq, 1 - avg(similarity) AS d FROM kn WHERE rank <= 5 GROUP BY 1), dt AS (SELECT query_seq % 50 AS trajectory_id, max(d) AS distance FROM ds GROUP BY 1),
sg AS (SELECT tr.*, coalesce(voi_flatness, 0) AS voi_flatness, coalesce(distance, 0) AS distance_from_trajectory FROM tr LEFT JOIN vf USING (trajectory_id) LEFT JOIN dt USING (trajectory_id)),
cp AS (SELECT *, ({_rp('entropy_plateau')} + {_rp('voi_flatness')} + {_rp('distance_from_trajectory')}) / 3 AS composite FROM sg)"""
ORACLES["compute_signatures"] = f"WITH {SIGNATURES} SELECT trajectory_id, " + ", ".join(_FLOAT(c, c) for c in ("entropy_plateau", "voi_flatness", "distance_from_trajectory", "mean_entropy", "mass_capture_mean", "mass_capture_min", "composite")) + " FROM cp"


def _signatures(spark, sf_dir):
    states = cut_lineage(X.states(spark, sf_dir).select("trajectory_id", "position", "distribution", "mass_capture"), "states")  # read twice
    return cut_lineage(_signed(states, spark, sf_dir).join(trajectory.scores(states).select("trajectory_id", "terminal_entropy"), "trajectory_id"), "signatures")


def component_table(spark, sf_dir):
    """The three components and the composite, with intervals."""
    return evaluate.component_table(_signatures(spark, sf_dir), X.truth(spark, sf_dir))


def composite_areas(spark, sf_dir):
    """The area of each composite of rank percentiles."""
    rows = _signatures(spark, sf_dir).where("terminal_entropy is not null")
    up = {"d": ("distance_from_trajectory", 1), "f": ("terminal_entropy", 1), "s": ("entropy_plateau", -1), "p": ("entropy_plateau", 1), "e": ("distance_from_trajectory", -1), "g": ("terminal_entropy", -1), "m": ("mass_capture_mean", -1), "l": ("mass_capture_min", -1)}
    ranks = rank_percentiles(rows, "trajectory_id", {k: F.round(F.col(c) * x, 6) + 0.0 for k, (c, x) in up.items()})
    mean = lambda names: sum((F.col(n) for n in names), F.lit(0.0)) / len(names)
    made = ranks.join(rows, "trajectory_id").select("trajectory_id", F.col("composite").alias("orig_3"), *[F.round(mean(v), 9).alias(n) for n, v in SWEEP.items()], F.round("mean_entropy", 6).alias("mean_h_only"))
    long = evaluate.long_scores(made, X.truth(spark, sf_dir), ["orig_3", *SWEEP, "mean_h_only"])
    return evaluate.deferral_auc(long).select("score_column", rounded("roc_auc"), "direction", "n_pos", "n_neg")


#: Composites by the names of their ranked parts.
SWEEP = {"corrected_3": "dfs", "mass_flipped": "dfsml", "all_flipped": "egp"}
QUERIES["component_table_ci"], QUERIES["composite_areas"] = component_table, composite_areas
_R6 = lambda c, x=1: _rp(f"(round({c} * {x}, 6) + 0.0)")
_F6 = {c: f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 6)" for c in ("distance_from_trajectory", "entropy_plateau", "mass_capture_mean", "mass_capture_min", "composite", "mean_entropy")}
ORACLES["composite_areas"] = f"""WITH {SIGNATURES}, {X.TRUTH}, fl AS (SELECT trajectory_id, terminal_entropy, {', '.join(f'{e} AS {c}' for c, e in _F6.items())} FROM cp WHERE terminal_entropy IS NOT NULL),
ra AS (SELECT *, {_R6('distance_from_trajectory')} AS d, {_R6('terminal_entropy')} AS f, {_R6('entropy_plateau', -1)} AS s, {_R6('entropy_plateau')} AS p, {_R6('distance_from_trajectory', -1)} AS e, {_R6('terminal_entropy', -1)} AS g, {_R6('mass_capture_mean', -1)} AS m, {_R6('mass_capture_min', -1)} AS l FROM fl),
sw AS (SELECT trajectory_id, composite AS orig_3, {', '.join(f"round(({' + '.join(v)}) / {len(v)}, 9) AS {n}" for n, v in SWEEP.items())}, mean_entropy AS mean_h_only FROM ra),
lg AS ({' UNION ALL '.join(f"SELECT '{c}' AS score_column, {c} AS score, target FROM sw JOIN truth USING (trajectory_id)" for c in ('orig_3', *SWEEP, 'mean_h_only'))}), {auc_sql('lg')}
SELECT score_column, {sql_rounded('roc_auc', 'roc_auc')}, CASE WHEN roc_auc >= 0.5 THEN 'greater' ELSE 'less' END AS direction, n_pos, n_neg FROM roc"""


def repair_summary(spark, sf_dir):
    """Counts by condition: successes, repairs, calls, mean signal."""
    r = C.condition_b(_questions(spark, sf_dir), DigestModel).unionByName(C.condition_a(_questions(spark, sf_dir), DigestModel))
    return C.repair_summary(r).select("condition_id", "n", "n_success", "n_repaired", "n_calls", rounded("signal"))


QUERIES["repair_summary"] = repair_summary


def _summary_sql(name: str, condition: str, signal: str) -> str:
    return f"SELECT condition_id, count(*) AS n, CAST(sum(success::INT) AS BIGINT) AS n_success, CAST(sum((repair_attempts > 0)::INT) AS BIGINT) AS n_repaired, CAST(sum(n_calls) AS BIGINT) AS n_calls, {sql_rounded('avg(deferral_signal) FILTER (success)', 'signal')} FROM (WITH {_asked_sql(name)} {_answers_sql(condition, signal)}) GROUP BY 1"


ORACLES["repair_summary"] = f"{_summary_sql('condition_a', 'A', '0.5::DOUBLE')} UNION ALL {_summary_sql('condition_b', 'B', _SIGNAL_B)}"


class FlakyModel(DigestModel):
    """Fails at every belief whose prompt's fourth digit is 13 or more."""

    def top_logprobs(self, prompt, k):
        if int(hashlib.md5(prompt.encode()).hexdigest()[3], 16) >= 13:
            raise M.ModelError("no belief")
        return super().top_logprobs(prompt, k)


def cond_c_repair(spark, sf_dir):
    """A measurement that fails is made again, that one alone; a question with
    one that fails again has no answer and one state."""
    results, states = C.condition_c(_questions(spark, sf_dir), FlakyModel, ["A", "B", "C"])
    kept = states.groupBy("trajectory_id").agg(F.count("*").alias("n_states"), F.count("distribution").alias("n_beliefs"))
    return results.join(kept, results.question_id == kept.trajectory_id).select("question_id", "predicted_answer", "success", "n_calls", "repair_attempts", F.col("error").like("a measurement failed%").alias("broken"), "n_states", "n_beliefs")


QUERIES["cond_c_repair"] = cond_c_repair
ORACLES["cond_c_repair"] = f"""WITH {_STATES_SQL}, b AS (SELECT question_id, count(*) FILTER (ok AND {_digit('mp', 3)} >= 13) AS bad FROM w GROUP BY 1)
SELECT question_id, CASE WHEN ok AND bad = 0 THEN CASE WHEN wa >= wb AND wa >= wc THEN 'A' WHEN wb >= wc THEN 'B' ELSE 'C' END END AS predicted_answer, ok AND bad = 0 AS success,
  CAST(CASE WHEN again THEN 2 ELSE 1 END + CASE WHEN ok THEN 1 + bad ELSE 0 END AS INTEGER) AS n_calls, CAST(CASE WHEN again THEN 1 ELSE 0 END + CASE WHEN bad > 0 THEN 1 ELSE 0 END AS INTEGER) AS repair_attempts,
  CASE WHEN NOT ok THEN false WHEN bad > 0 THEN true END AS broken, CASE WHEN ok AND bad = 0 THEN n + 1 ELSE 1 END AS n_states, CASE WHEN ok AND bad = 0 THEN n + 1 ELSE 0 END AS n_beliefs FROM w JOIN b USING (question_id) WHERE k = n"""


def state_identities(spark, sf_dir):
    """state_hash: a question's own hash before any step, and how many states
    are told apart by their steps' embeddings."""
    _, states = C.condition_c(_questions(spark, sf_dir), DigestModel, ["A", "B", "C"], embedder=M.HashEmbedder)
    return states.groupBy("trajectory_id").agg(F.max(F.when(F.col("position") == 0, F.col("node_id"))).alias("first_id"), F.count_distinct("node_id").alias("n_ids"), F.count_distinct("action_id_to_next").alias("n_actions"))


QUERIES["state_hash"] = state_identities
ORACLES["state_hash"] = f"WITH {_STATES_SQL} SELECT question_id AS trajectory_id, sha256({_TEXT}) AS first_id, CASE WHEN ok THEN n + 1 ELSE 1 END AS n_ids, CASE WHEN ok THEN n ELSE 0 END AS n_actions FROM w WHERE k = n"


class PrefilledModel(DigestModel):
    """The mass of a belief tells how long a beginning the model was told."""

    told = ""

    def prefill(self, prefix):
        self.told = prefix

    def top_logprobs(self, prompt, k):
        mass = (len(self.told) % 97 + 1) / 100 if prompt.startswith(self.told) else 0.001
        return {t: v + math.log(mass / 0.9) for t, v in super().top_logprobs(prompt, k).items()}


def shared_prefix(spark, sf_dir):
    """Beliefs of a model that is told what a question's prompts share."""
    _, states = C.condition_c(_questions(spark, sf_dir), PrefilledModel, ["A", "B", "C"])
    return states.where("distribution is not null").select("trajectory_id", "position", rounded("mass_capture"))


QUERIES["llm_shared_prefix"] = shared_prefix
ORACLES["llm_shared_prefix"] = f"""WITH {_STATES_SQL}, e AS (SELECT question_id, min(mp) AS a, max(mp) AS b FROM w GROUP BY 1),
l AS (SELECT question_id, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS n FROM e)
SELECT question_id AS trajectory_id, CAST(k AS INTEGER) AS position, {sql_rounded('(l.n % 97 + 1) / 100', 'mass_capture')} FROM w JOIN l USING (question_id) WHERE ok"""
