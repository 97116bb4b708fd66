"""The three ways to question a model: answer, answer with confidence, and
reasoning with a belief measured after each step.

Every set of model calls is written as a table before anything reads it, so
that each prompt is asked once. Results have question_id, condition_id,
predicted_answer, deferral_signal, success, error, raw_output, n_calls and
repair_attempts; those of reasoning also the decomposition's warnings, the
number of steps found and of measurements that missed an answer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import text as T
from brindle.functions import uncertainty as U
from brindle.operators import measure as M
from brindle.sources.store import cut_lineage

# Prompt templates of this engine; the first line is their version.
PROMPTS = {
    "condition_a": "# version: 1\nAnswer the question with one letter.\n\n{question}\n{choices}\n\nEnd with: Final answer: <letter>\n",
    "condition_b": "# version: 1\nAnswer with one letter and your confidence from 0 to 1.\n\n{question}\n{choices}\n\nEnd with two lines:\nFinal answer: <letter>\nConfidence: <number>\n",
    "condition_c_initial": "# version: 1\nThink in numbered steps, each on a line that begins with 'Reasoning step N:'.\n\n{question}\n{choices}\n\nEnd with: Final answer: <letter>\n",
    "condition_c_measurement": "# version: 1\n{question}\n{choices}\n\n{reasoning_so_far}Final answer: ",
    "repair": "# version: 1\n{prompt}\n\nThis reply could not be read:\n{reply}\nKeep to the asked format.\n",
}


def template(name: str) -> str:
    head, _, body = PROMPTS[name].partition("\n")
    if not head.startswith("# version:"):
        raise ValueError(f"prompt {name} has no version header")
    return body


def versions() -> dict[str, int]:
    return {n: int(p.partition("\n")[0].split(":")[1]) for n, p in PROMPTS.items()}


def _asked(questions: DataFrame, name: str) -> DataFrame:
    prompt = T.fill(template(name), question=F.col("question"), choices=T.format_choices(F.col("choices")))
    return questions.withColumn("prompt", prompt)


def _responses(questions: DataFrame, name: str, factory: Callable, bad: Callable[[], Column], repairs: int) -> DataFrame:
    """``questions`` with response, error, n_calls and repair_attempts: asked
    once, and again where ``bad`` holds of the response, ``repairs`` times at
    most, for those questions only."""
    if repairs < 0:
        raise ValueError("repairs must not be negative")
    asked = _asked(questions, name)
    names = asked.columns
    said = cut_lineage(M.generate(asked, factory).drop("sample").withColumn("n_calls", F.lit(1)).withColumn("repair_attempts", F.lit(0)), "responses")
    for _ in range(repairs):
        trouble = F.col("error").isNull() & bad()
        open_ = said.where(trouble)
        if open_.isEmpty():
            break
        again = open_.withColumn("_first", F.col("prompt")).withColumn("prompt", T.fill(template("repair"), prompt=F.col("prompt"), reply=F.coalesce("response", F.lit("")))).drop("response", "error")
        redone = M.generate(again, factory).drop("sample", "prompt").withColumnRenamed("_first", "prompt")
        redone = redone.withColumn("n_calls", F.col("n_calls") + 1).withColumn("repair_attempts", F.col("repair_attempts") + 1)
        said = cut_lineage(said.where(~trouble).unionByName(redone.select(*said.columns)), "responses")
    return said.select(*names, "response", "error", "n_calls", "repair_attempts")


def _answered(said: DataFrame, condition: str, signal: Column) -> DataFrame:
    answer = T.final_answer(F.col("response"))
    return said.select(
        "question_id", F.lit(condition).alias("condition_id"), answer.alias("predicted_answer"), signal.alias("deferral_signal"), (F.col("error").isNull() & answer.isNotNull()).alias("success"), "error", F.col("response").alias("raw_output"), "n_calls", "repair_attempts"
    )


def condition_a(questions: DataFrame, factory: Callable[[], M.LanguageModel], repairs: int = 1) -> DataFrame:
    """One answer a question; the signal is 0.5 throughout."""
    said = _responses(questions, "condition_a", factory, lambda: T.final_answer(F.col("response")).isNull(), repairs)
    return _answered(said, "A", F.lit(0.5))


def condition_b(questions: DataFrame, factory: Callable[[], M.LanguageModel], repairs: int = 1) -> DataFrame:
    """Answer and stated confidence; the signal is 1 - confidence, and 0.5
    where none could be read."""
    sure = lambda: T.parse_confidence(F.col("response"))
    said = _responses(questions, "condition_b", factory, lambda: T.final_answer(F.col("response")).isNull() | sure().isNull(), repairs)
    return _answered(said, "B", 1 - F.coalesce(sure(), F.lit(0.5)))


def condition_c(questions: DataFrame, factory: Callable[[], M.LanguageModel], space: list[str], max_steps: int = 10, repairs: int = 1, embedder: Callable[[], M.Embedder] | None = None, precision: int = 8, id_in_hash: bool = False, shared: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, states): reasoning is decomposed and a belief measured before
    it and after each step, N + 1 states and N actions a question. The
    prediction is the leading answer of the last state.

    A response without steps is asked for again, and a measurement that failed
    is made again, that one alone. A question that still fails has one state,
    the one before reasoning, without embedding or belief; ``error`` says at
    which point. With an ``embedder`` a state's identity covers its steps'
    embeddings, states and actions have embeddings, and actions identities;
    without, states are told apart by the question's hash and the prompt.
    ``shared`` tells the model what all prompts of a question begin with, before
    the first of them, so that it is worked out once; by default if ``factory``
    is a class with ``prefill``."""
    steps = lambda: T.decompose(F.col("response"), max_steps)
    said = _responses(questions, "condition_c_initial", factory, lambda: F.size(steps()["steps"]) == 0, repairs)
    qid = F.col("question_id") if id_in_hash else None
    parts = said.withColumn("d", F.when(F.col("error").isNull(), steps())).withColumn("steps", F.coalesce("d.steps", F.array().cast("array<string>")))
    parts = parts.withColumn("_text", M.question_text(F.col("question"), F.col("choices"), qid))
    if embedder is not None:
        parts = M.embed_lists(parts.withColumn("_texts", F.concat(F.array("question"), "steps")), embedder, "_texts", "_vectors")
        parts = parts.withColumn("_steps", F.slice("_vectors", 2, F.greatest(F.size("_vectors") - 1, F.lit(0))))
        parts = M.state_hashes(parts, "_text", "_steps", precision, "node_ids")
    parts = cut_lineage(parts, "reasoning")
    prompts = T.prefix_prompts(template("condition_c_measurement"), F.col("question"), F.col("choices"), F.col("steps"))
    asked = parts.where("size(steps) > 0").select("question_id", F.posexplode(prompts).alias("position", "prompt"))
    if hasattr(factory, "prefill") if shared is None else shared:
        asked = M.shared_prefix(asked, "question_id")
    asked = asked.repartition("question_id").sortWithinPartitions("question_id", "position")
    read = cut_lineage(M.measure(asked, factory, space, retries=0), "beliefs")
    broken = read.where("error is not null")
    if not broken.isEmpty():
        mended = M.measure(M.failed(read), factory, space, retries=0)
        read = cut_lineage(read.where("error is null").withColumn("mended", F.lit(0)).unionByName(mended.withColumn("mended", F.lit(1)).select(*read.columns, "mended")), "beliefs")
    else:
        read = read.withColumn("mended", F.lit(0))
    last = read.groupBy("question_id").agg(F.max_by("distribution", "position").alias("final"), F.max("error").alias("_trouble"), F.max("mended").alias("_mended"), F.sum("mended").alias("_again"), F.sum(F.size("truncated")).alias("n_truncated"))
    joined = parts.join(last, "question_id", "left")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.size("steps") == 0, "no steps in the response").when(F.col("_trouble").isNotNull(), F.concat(F.lit("a measurement failed: "), "_trouble"))
    joined = cut_lineage(joined.withColumn("_reason", reason), "outcomes")
    predicted = F.when(F.col("_reason").isNull(), U.argmax(F.col("final")))
    calls = F.col("n_calls") + F.when(F.size("steps") > 0, 1 + F.coalesce("_again", F.lit(0))).otherwise(0)
    results = joined.select(
        "question_id",
        F.lit("C").alias("condition_id"),
        predicted.alias("predicted_answer"),
        F.lit(None).cast("double").alias("deferral_signal"),
        predicted.isNotNull().alias("success"),
        F.col("_reason").alias("error"),
        F.col("response").alias("raw_output"),
        calls.cast("int").alias("n_calls"),
        (F.col("repair_attempts") + F.coalesce("_mended", F.lit(0))).alias("repair_attempts"),
        F.col("d.warnings").alias("warnings"),
        F.col("d.n_raw").alias("n_steps_raw"),
        F.col("n_truncated").cast("int").alias("n_truncated"),
    )
    return results, _states(joined, read, embedder is not None, precision)


def _states(joined: DataFrame, read: DataFrame, embedded: bool, precision: int) -> DataFrame:
    """State rows in the form of the trajectory artifact, with the action that
    follows each: of questions that went well all N + 1, of others one."""
    keep = ["question_id", "steps", "_reason", "_text", *(["node_ids", "_vectors"] if embedded else [])]
    good = joined.where("_reason is null").select(*keep).join(read, "question_id")
    bad = joined.where("_reason is not null").select(*keep).withColumn("position", F.lit(0))
    bad = bad.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in read.schema.fields if f.name not in bad.columns])
    rows = good.unionByName(bad.select(*good.columns)).withColumn("ok", F.col("_reason").isNull())
    at = F.col("position")
    nothing = F.lit(None).cast("array<float>")
    if embedded:
        # A step's vector comes after the question's.
        rows = rows.withColumn("embedding", F.when(F.col("ok"), F.get("_vectors", at))).withColumn("_next", F.when(F.col("ok"), F.get("_vectors", at + 1))).withColumn("node_id", F.get("node_ids", at))
        rows = M.action_hash(rows, "_next", precision, "action_id_to_next", "position")
    else:
        node = F.when(at == 0, F.sha2("_text", 256)).otherwise(F.sha2(F.concat("_text", "prompt"), 256))
        rows = rows.withColumn("embedding", nothing).withColumn("node_id", node).withColumn("action_id_to_next", F.lit(None).cast("string"))
    follow = F.when(F.col("ok"), F.get("steps", at))
    return rows.select(
        F.col("question_id").alias("trajectory_id"),
        "position",
        at.alias("timestep"),
        "node_id",
        "embedding",
        F.when(F.col("ok") & (at > 0), F.get("steps", at - 1)).alias("step_text"),
        F.when(F.col("ok"), F.col("distribution")).alias("distribution"),
        F.when(F.col("ok"), F.col("mass_capture")).alias("mass_capture"),
        F.when(F.col("ok"), F.col("top_k")).alias("top_k_logprobs"),
        F.when(F.col("ok"), F.col("truncated")).alias("truncated"),
        "action_id_to_next",
        F.when(follow.isNotNull(), F.struct(at.alias("step_position"), F.char_length(follow).alias("step_text_len"))).alias("action_metadata"),
        F.struct(F.col("question_id"), F.lit("C").alias("condition"), (at == 0).alias("is_prior"), F.col("_reason").alias("failure_reason")).alias("metadata"),
    )


def lean_capture(states: DataFrame, key: DataFrame, space: list[str], label: str = "answer_letter") -> DataFrame:
    """question_id, gold, pred, n_steps and, in the order of the states, the
    lists ent (bits over ``space``; uniform without mass), entfull and varent
    (nats over the top K): what reasoning runs keep when they keep little."""
    spread = lambda c: F.map_values(F.coalesce(c, F.create_map().cast("map<string,double>")))
    row = F.struct(
        "position",
        U.entropy_of_list(U.projected(F.col("distribution"), space)).alias("ent"),
        U.entropy_full_renormalized(spread(F.col("top_k_logprobs"))).alias("entfull"),
        U.varentropy(spread(F.col("top_k_logprobs"))).alias("varent"),
        U.argmax(F.col("distribution")).alias("pred"),
    )
    own = states.where("distribution is not null").groupBy("trajectory_id").agg(F.array_sort(F.collect_list(row)).alias("s"))
    listed = lambda c: F.transform("s", lambda x: x[c]).alias(c)
    told = own.select(F.col("trajectory_id").alias("question_id"), F.element_at("s", -1)["pred"].alias("pred"), F.size("s").alias("n_steps"), listed("ent"), listed("entfull"), listed("varent"))
    return told.join(key.select("question_id", F.col(label).alias("gold")), "question_id").select("question_id", "gold", "pred", "n_steps", "ent", "entfull", "varent")


def successful(results: DataFrame) -> DataFrame:
    return results.where("success")


def repair_summary(results: DataFrame) -> DataFrame:
    """Counts by condition: questions, successes, those asked again, calls and
    the mean signal of the successes."""
    ok = F.col("success")
    return results.groupBy("condition_id").agg(
        F.count("*").alias("n"),
        F.sum(ok.cast("int")).alias("n_success"),
        F.sum((F.col("repair_attempts") > 0).cast("int")).alias("n_repaired"),
        F.sum("n_calls").alias("n_calls"),
        F.avg(F.when(ok, F.col("deferral_signal"))).alias("signal"),
    )
