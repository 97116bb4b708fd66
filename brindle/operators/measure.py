"""Measurement connectors: language models and embedders inside mapInPandas.

A model is any object with the methods of ``LanguageModel``; one that also has
``generate_batch`` or ``top_logprobs_batch`` is asked for a batch at a time,
and one that has ``prefill`` is told a shared prefix when it changes. Operators
take a factory, called once a task, so that a client or a loaded model is
shared by the task's rows. Failures never stop a job: a row that fails after
its retries has ``error`` set, and ``failed`` picks such rows out for another
run. Where a batch fails at one row and says what it has, only that row is
asked for again.

Plans are lazy and models are not free: write a result as a table before it is
read twice (``conditions`` does).
"""

from __future__ import annotations

import hashlib
import json
import math
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import question_hash


class ModelError(RuntimeError):
    """A model gave no answer. Of a batch, ``failed_index`` is the row that
    failed and ``partial_results`` the others' results, where known."""

    def __init__(self, message: str, failed_index: int | None = None, partial_results: Sequence | None = None):
        super().__init__(message)
        self.failed_index, self.partial_results = failed_index, partial_results


class ModelUnreachable(ModelError):
    """No connection."""


class ModelTimeout(ModelError):
    """No reply in time."""


class ModelStatus(ModelError):
    """A reply of an error status."""


class ModelReply(ModelError):
    """A reply that has not the expected form."""


class LanguageModel(Protocol):
    def generate(self, prompt: str, max_tokens: int | None = None, temperature: float = 0.0, seed: int | None = None) -> str: ...

    def top_logprobs(self, prompt: str, k: int) -> dict[str, float]: ...

    def metadata(self) -> dict[str, str]: ...


class Embedder(Protocol):
    def embed_batch(self, texts: Sequence[str]) -> np.ndarray: ...


class StateCanonicalizer(Protocol):
    """Rows (question, choices, steps) with the identity of each state."""

    def canonicalize(self, rows: DataFrame) -> DataFrame: ...


class ActionCanonicalizer(Protocol):
    """Rows (step text, position) with the action's identity."""

    def canonicalize(self, rows: DataFrame) -> DataFrame: ...


class OutcomeExtractor(Protocol):
    def extract(self, questions: DataFrame) -> DataFrame: ...


class TrajectorySource(Protocol):
    def metadata(self) -> dict: ...

    def load(self) -> tuple[DataFrame, DataFrame]: ...


class _Server:
    """Posts JSON and sorts what may go wrong."""

    def __init__(self, url: str, model: str, timeout: float = 120.0, seed: int = 42):
        self.url, self.model, self.timeout, self.seed = url, model, timeout, seed

    def metadata(self) -> dict[str, str]:
        return {"adapter_name": type(self).__name__, "model": self.model}

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                return json.load(reply)
        except urllib.error.HTTPError as error:
            raise ModelStatus(f"status {error.code} from {self.url}") from error
        except TimeoutError as error:
            raise ModelTimeout(f"no reply from {self.url} in {self.timeout} s") from error
        except urllib.error.URLError as error:
            kind = ModelTimeout if isinstance(error.reason, TimeoutError) else ModelUnreachable
            raise kind(f"{self.url}: {error.reason}") from error
        except ValueError as error:
            raise ModelReply(f"{self.url} sent no JSON") from error


class CompletionServer(_Server):
    """A model behind an HTTP completions endpoint."""

    def _first(self, seed: int | None = None, **body) -> dict:
        reply = self._post({"model": self.model, "seed": self.seed if seed is None else seed} | body)
        try:
            return reply["choices"][0]
        except (KeyError, IndexError, TypeError) as error:
            raise ModelReply(f"{self.url} sent no choice") from error

    def generate(self, prompt: str, max_tokens: int | None = None, temperature: float = 0.0, seed: int | None = None) -> str:
        return self._first(seed, prompt=prompt, max_tokens=max_tokens or 1024, temperature=temperature)["text"]

    def top_logprobs(self, prompt: str, k: int) -> dict[str, float]:
        first = self._first(prompt=prompt, max_tokens=1, temperature=0.0, logprobs=k)["logprobs"]
        if "content" in first:
            return {t["token"]: float(t["logprob"]) for t in first["content"][0]["top_logprobs"]}
        return {t: float(v) for t, v in first["top_logprobs"][0].items()}


class TextServer(_Server):
    """A model behind an endpoint that generates text and has no
    probabilities (the generate call of common local servers)."""

    def generate(self, prompt: str, max_tokens: int | None = None, temperature: float = 0.0, seed: int | None = None) -> str:
        options = {"temperature": temperature, "seed": self.seed if seed is None else seed} | ({"num_predict": max_tokens} if max_tokens else {})
        reply = self._post({"model": self.model, "prompt": prompt, "stream": False, "options": options})
        if not isinstance(reply.get("response"), str):
            raise ModelReply(f"{self.url} sent no response")
        return reply["response"]

    def top_logprobs(self, prompt: str, k: int) -> dict[str, float]:
        raise ModelError("this endpoint has no token probabilities")


class ScriptedModel:
    """A model for tests: fixed responses, probabilities from a hash."""

    def __init__(self, response: str = "Reasoning step 1: a\nReasoning step 2: b\nReasoning step 3: c\nFinal answer: A", space: Sequence[str] = "ABCD"):
        self.response, self.space = response, list(space)

    def generate(self, prompt: str, max_tokens: int | None = None, temperature: float = 0.0, seed: int | None = None) -> str:
        return self.response

    def metadata(self) -> dict[str, str]:
        return {"adapter_name": "ScriptedModel", "model": "none"}

    def top_logprobs(self, prompt: str, k: int) -> dict[str, float]:
        digest = hashlib.sha256(prompt.encode()).digest()
        weights = [1 + b for b in digest[: len(self.space)]]
        return {t: math.log(0.9 * w / sum(weights)) for t, w in zip(self.space, weights, strict=True)}


class HashEmbedder:
    """A seeded stand-in for an embedder: unit vectors from a text's hash."""

    def __init__(self, dimension: int = 8):
        self.dimension = dimension

    def embed_batch(self, texts: Sequence[str]) -> np.ndarray:
        out = []
        for t in texts:
            v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "big")).normal(size=self.dimension)
            out.append(v / np.linalg.norm(v))
        return np.array(out, np.float32).reshape(-1, self.dimension)


# How many tokens are asked for (40, or 10 for each answer, and
# four times that again), and the forms of an answer's token.
LEAST_K, K_EACH, WIDER = 40, 10, 4
FORMS = ("", " ", "\n")


def asked_for(space: Sequence[str]) -> int:
    return max(LEAST_K, K_EACH * len(space))


def alias_probabilities(top: dict[str, float], space: Sequence[str]) -> dict[str, float]:
    """Members of ``space`` that occur, with the sum over their token forms."""
    found = {}
    for member in space:
        forms = [math.exp(top[f + member]) for f in FORMS if f + member in top]
        if forms:
            found[member] = sum(forms)
    return found


def read_belief(model: LanguageModel, prompt: str, space: Sequence[str], retries: int = 2) -> dict:
    """One measurement: distribution, mass, cut members, top-K. K is asked for
    again at four times the size if a member is missing; members that stay
    missing have 0; no mass at all is an error."""
    space = list(dict.fromkeys(space))
    if not space:
        raise ValueError("the token set is empty")
    k, trouble = asked_for(space), None
    for _ in range(retries + 1):
        try:
            top = model.top_logprobs(prompt, k)
            if len(alias_probabilities(top, space)) < len(space):
                top = model.top_logprobs(prompt, WIDER * k)
            break
        except Exception as error:  # noqa: BLE001  what a transport may raise is open
            trouble = error
    else:
        raise ModelError(f"no measurement after {retries + 1} attempts: {trouble}")
    return belief(top, space)


def belief(top: dict[str, float], space: Sequence[str]) -> dict:
    found = alias_probabilities(top, space)
    mass = sum(found.values())
    if mass <= 0:
        raise ModelError("no mass on the token set")
    return {"distribution": {m: found.get(m, 0.0) / mass for m in space}, "mass_capture": mass, "truncated": [m for m in space if m not in found], "top_k": top}


BELIEF = "distribution map<string,double>, mass_capture double, truncated array<string>, top_k map<string,double>, error string"
NO_BELIEF = {"distribution": None, "mass_capture": None, "truncated": None, "top_k": None}


def _batch(ask_all: Callable[[list], Sequence], items: list) -> list:
    """Results of a batch call, with None where a row is to be asked for on
    its own: the one that failed, or all if the call says nothing of them."""
    try:
        return list(ask_all(items))
    except ModelError as error:
        if error.failed_index is not None and error.partial_results is not None and len(error.partial_results) == len(items):
            return [None if k == error.failed_index else r for k, r in enumerate(error.partial_results)]
        return [None] * len(items)
    except Exception:  # noqa: BLE001  what a transport may raise is open
        return [None] * len(items)


def shared_prefix(prompts: DataFrame, group: str, prompt: str = "prompt", column: str = "prefix") -> DataFrame:
    """``prompts`` with the longest text that all prompts of a group begin
    with: that of the least and the greatest of them."""
    ends = prompts.groupBy(group).agg(F.min(prompt).alias("_lo"), F.max(prompt).alias("_hi"))

    @F.pandas_udf("string")
    def common(lo: pd.Series, hi: pd.Series) -> pd.Series:
        import os

        return pd.Series([os.path.commonprefix([a, b]) for a, b in zip(lo, hi, strict=True)], dtype=object)

    return prompts.join(ends.select(group, common("_lo", "_hi").alias(column)), group)


def _told_prefix(model, batch: pd.DataFrame, at: int, last: str | None) -> str | None:
    """Tell the model a prefix where it is not the one told before."""
    if "prefix" not in batch or not hasattr(model, "prefill"):
        return last
    now = batch["prefix"].iloc[at]
    if now != last:
        model.prefill(now)
    return now


def measure(prompts: DataFrame, factory: Callable[[], LanguageModel], space: Sequence[str], prompt: str = "prompt", retries: int = 2) -> DataFrame:
    """``prompts`` with the belief read at each prompt's end. Deal prompts of
    one question together beforehand (and give them a ``prefix`` column) to
    let a model share their beginning."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields)
    space = list(dict.fromkeys(space))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, last = factory(), None
        for batch in batches:
            texts = batch[prompt].tolist()
            tops: list = [None] * len(texts)
            if hasattr(model, "top_logprobs_batch") and space:
                tops = _batch(lambda p: model.top_logprobs_batch(p, asked_for(space)), texts)
                tops = [t if t is not None and len(alias_probabilities(t, space)) == len(space) else None for t in tops]
            rows = []
            for k, (text, top) in enumerate(zip(texts, tops, strict=True)):
                last = _told_prefix(model, batch, k, last)
                try:
                    rows.append((read_belief(model, text, space, retries) if top is None else belief(top, space)) | {"error": None})
                except Exception as error:  # noqa: BLE001
                    rows.append(NO_BELIEF | {"error": str(error)})
            told = pd.DataFrame(rows, columns=[*NO_BELIEF, "error"], index=batch.index)
            yield pd.concat([batch, told], axis=1)

    return prompts.mapInPandas(of, f"{fields}, {BELIEF}")


def generate(prompts: DataFrame, factory: Callable[[], LanguageModel], prompt: str = "prompt", samples: int = 1, temperature: float = 0.0, retries: int = 2, seed: int = 42) -> DataFrame:
    """``prompts`` with sample (0, 1, ...), response and error; ``samples``
    rows for each prompt, each asked for with a seed of its own, ``seed`` plus
    its number."""
    spread = prompts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spread.schema.fields)

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, last = factory(), None
        for batch in batches:
            texts, seeds = batch[prompt].tolist(), [seed + int(x) for x in batch["sample"]]
            said: list = [None] * len(texts)
            if hasattr(model, "generate_batch"):
                said = _batch(lambda p: model.generate_batch(p, temperature=temperature, seeds=seeds), texts)  # noqa: B023
            errors: list = [None] * len(texts)
            for k, text in enumerate(texts):
                last = _told_prefix(model, batch, k, last)
                for turn in range(retries + 1 if said[k] is None else 0):
                    try:
                        said[k], errors[k] = model.generate(text, temperature=temperature, seed=seeds[k]), None
                        break
                    except Exception as error:  # noqa: BLE001
                        errors[k] = str(error)
            yield batch.assign(response=said, error=errors)

    return spread.mapInPandas(of, f"{fields}, response string, error string")


def failed(rows: DataFrame) -> DataFrame:
    """Rows to run again, without their results."""
    names = [c for c in rows.columns if c not in ("distribution", "mass_capture", "truncated", "top_k", "response", "error")]
    return rows.where("error is not null").select(*names)


def embed(rows: DataFrame, factory: Callable[[], Embedder], text: str = "text", column: str = "embedding", prefix: str = "") -> DataFrame:
    """``rows`` with unit-length embeddings; null texts have none."""

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            have = batch.notna()
            found = model.embed_batch([prefix + t for t in batch[have]])
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            for i, v in zip(batch.index[have], found, strict=True):
                out[i] = (v / max(float(np.linalg.norm(v)), 1e-12)).astype(np.float32)
            yield out

    return rows.withColumn(column, vectors(text))


def _binned(vectors, precision: int) -> bytes:
    return np.round(np.asarray(vectors, np.float32), precision).astype(np.float32).tobytes()


def action_hash(rows: DataFrame, column: str = "embedding", precision: int = 8, name: str = "action_id", position: str | None = None) -> DataFrame:
    """SHA-256 of a step's embedding rounded to ``precision``, as float32
    bytes; behind the step's position if one is named."""
    if precision < 1:
        raise ValueError("the precision must be 1 or more")
    where = F.col(position).cast("int") if position else F.lit(-1)

    @F.pandas_udf("string")
    def digest(vectors: pd.Series, places: pd.Series) -> pd.Series:
        head = lambda k: b"" if k < 0 else b"pos:%d\0" % k
        return pd.Series([None if v is None else hashlib.sha256(head(k) + b"step:" + _binned(v, precision)).hexdigest() for v, k in zip(vectors, places, strict=True)], dtype=object)

    return rows.withColumn(name, digest(F.col(column), where))


def question_text(question: Column, choices: Column, question_id: Column | None = None) -> Column:
    """The bytes that a question's identity is the hash of, as text."""
    return question_hash(question, choices, question_id, digest=False)


def state_hashes(rows: DataFrame, text: str, embeddings: str, precision: int = 8, name: str = "node_ids") -> DataFrame:
    """``rows`` with the identities of a question's states: SHA-256 of ``text``
    (see ``question_text``) and, after each step, of the embeddings of the
    steps so far, rounded, as float32 bytes. The first one, without steps, is
    the question's hash."""
    if precision < 1:
        raise ValueError("the precision must be 1 or more")

    @F.pandas_udf("array<string>")
    def digests(texts: pd.Series, vectors: pd.Series) -> pd.Series:
        out = []
        for t, steps in zip(texts, vectors, strict=True):
            base = hashlib.sha256(t.encode())
            ids, own = [base.hexdigest()], base.copy()
            own.update(b"steps:")
            for v in steps if steps is not None else []:
                own.update(_binned(v, precision))
                ids.append(own.hexdigest())
            out.append(ids)
        return pd.Series(out, dtype=object)

    return rows.withColumn(name, digests(F.col(text), F.col(embeddings)))


def embed_lists(rows: DataFrame, factory: Callable[[], Embedder], texts: str, column: str = "embeddings") -> DataFrame:
    """``rows`` with unit-length embeddings of each text of a list, one call
    of the embedder for a batch of rows."""

    @F.pandas_udf("array<array<float>>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for batch in batches:
            flat = [t for own in batch if own is not None for t in own]
            found = np.asarray(model.embed_batch(flat), np.float32) if flat else np.zeros((0, 1), np.float32)
            found = (found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)).astype(np.float32)
            at, out = 0, []
            for own in batch:
                n = 0 if own is None else len(own)
                out.append(None if own is None else [v for v in found[at : at + n]])
                at += n
            yield pd.Series(out, dtype=object)

    return rows.withColumn(column, vectors(texts))


def sample_token(rows: DataFrame, logits: str, unit: Sequence[str], temperature: float = 0.0, seed: int = 42, name: str = "token") -> DataFrame:
    """The place of the largest logit, or at a temperature a categorical draw
    by Gumbel noise; noise depends on the seed and the row's ``unit`` columns,
    so rows of equal logits draw independently and reruns draw alike."""
    if temperature <= 0:
        return rows.withColumn(name, F.array_position(logits, F.array_max(logits)) - 1)
    noise = lambda i: -F.ln(-F.ln((F.pmod(F.xxhash64(*unit, i, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    noisy = F.transform(logits, lambda x, i: x / temperature + noise(i))
    return rows.withColumn("_noisy", noisy).withColumn(name, F.array_position("_noisy", F.array_max("_noisy")) - 1).drop("_noisy")


def semantic_entropy(questions: DataFrame, factory: Callable[[], LanguageModel], space: Sequence[str], samples: int = 6, temperature: float = 0.7, prompt: str = "prompt", seed: int = 42) -> DataFrame:
    """question_id, semantic_entropy, n_valid_samples, n_forced: the entropy
    (bits) of the answers in ``samples`` responses. A response without a
    readable answer is read by the belief after it. No answer at all: NaN."""
    from brindle.functions import uncertainty as U
    from brindle.functions.text import extract_letter
    from brindle.sources.store import cut_lineage

    letters = F.array(*map(F.lit, space))
    said = cut_lineage(generate(questions, factory, prompt, samples, temperature, seed=seed), "samples").withColumn("letter", extract_letter(F.col("response"), letters))
    unread = said.where(F.col("letter").isNull() & (F.trim("response") != "")).select("question_id", F.concat(prompt, "response", F.lit("\nAnswer:")).alias("prompt"))
    forced = cut_lineage(measure(unread, factory, space), "forced").where("error is null").select("question_id", U.argmax(F.col("distribution")).alias("letter"), F.lit(1).alias("forced"))
    every = said.where("letter is not null").select("question_id", "letter", F.lit(0).alias("forced")).unionByName(forced)
    counts = every.groupBy("question_id", "letter").agg(F.count("*").alias("c"), F.sum("forced").alias("f"))
    n = F.sum("c")
    found = counts.groupBy("question_id").agg(F.greatest(F.lit(0.0), F.log2(n) - F.sum(F.col("c") * F.log2("c")) / n).alias("h"), n.alias("n"), F.sum("f").alias("f"))
    out = questions.select("question_id").join(found, "question_id", "left")
    return out.select("question_id", F.coalesce("h", F.lit(float("nan"))).alias("semantic_entropy"), F.coalesce("n", F.lit(0)).alias("n_valid_samples"), F.coalesce("f", F.lit(0)).alias("n_forced"))
