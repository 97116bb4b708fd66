"""Column functions over model output: steps, answers, confidences, hashes.

Patterns use the flags (?imdU) so that lines end at line feeds only and
classes are Unicode's.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The output format that prompts ask for.
STEP = r"(?imdU)^Reasoning step (\d+):\s*(.*)$"
ANSWER = r"(?iU)[*_]{0,2}\s*Final\s+answer\s*[:\-]?\s*[*_]{0,2}\s*[(\['\"]?\s*([A-D])\b"
CONFIDENCE = r"(?imdU)^\s*Confidence:\s*([0-9]*\.?[0-9]+)\s*$"
ANSWER_LETTER = r"(?iU)answer\s*[:=]?\s*\(?\s*([A-E])\b"
LONE_LETTER = r"(?U)\b([A-E])\b"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def final_answer(text: Column) -> Column:
    """The last final answer's letter, upper case; null without."""
    return F.upper(F.try_element_at(F.regexp_extract_all(text, F.lit(ANSWER), F.lit(1)), F.lit(-1)))


def even_places(n: Column, target: int) -> Column:
    """0-based places of ``target`` of n items, evenly spread and rounded half
    to even; all places when there are no more than ``target``."""
    every = F.sequence(F.lit(0), n - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(target - 1)), lambda i: F.bround(i * (n - 1) / F.lit(float(max(target - 1, 1)))).cast("int"))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= target, every).otherwise(spread)


def decompose(text: Column, max_steps: int = 10, min_steps: int = 3, strict: bool = False) -> Column:
    """struct(steps, answer, n_raw, used_fallback, warnings) of a response.

    Steps are the marked lines of the text without its answers; without any,
    its paragraphs. More than ``max_steps`` are thinned evenly."""
    if not 1 <= min_steps <= max_steps:
        raise ValueError("1 <= min_steps <= max_steps is needed")
    body = F.regexp_replace(text, ANSWER, "")
    marked = F.transform(F.regexp_extract_all(body, F.lit(STEP), F.lit(2)), stripped)
    paragraphs = F.filter(F.transform(F.split(body, r"(?U)\n\s*\n"), stripped), lambda p: p != "")
    fallback = F.size(marked) == 0
    raw = F.when(fallback & F.lit(not strict), paragraphs).otherwise(marked)

    def told(v: Column) -> Column:
        n = F.size(v["raw"])
        steps = v["raw"]
        thinned = F.transform(even_places(n, max_steps), lambda i: F.get(steps, i))
        notes = F.array(
            F.when(v["answer"].isNull(), F.lit("no final answer")),
            F.when(v["fallback"] & (n > 0), F.lit("paragraphs used")),
            F.when(n == 0, F.lit("no steps")).when(n < min_steps, F.lit("few steps")).when(n > max_steps, F.lit("thinned")),
        )
        out = F.struct(thinned.alias("steps"), v["answer"].alias("answer"), n.alias("n_raw"), (v["fallback"] & (n > 0)).alias("used_fallback"), F.filter(notes, lambda x: x.isNotNull()).alias("warnings"))
        if not strict:
            return out
        kind = "struct<steps:array<string>,answer:string,n_raw:int,used_fallback:boolean,warnings:array<string>>"
        return F.when(n < min_steps, F.raise_error(F.concat(F.lit("too few reasoning steps: "), n.cast("string"))).cast(kind)).otherwise(out)

    packed = F.array(F.struct(raw.alias("raw"), final_answer(text).alias("answer"), fallback.alias("fallback")))
    return F.get(F.transform(packed, told), F.lit(0))


def parse_confidence(text: Column) -> Column:
    """The first confidence line's number; null without or outside [0, 1]."""
    value = F.try_element_at(F.regexp_extract_all(text, F.lit(CONFIDENCE), F.lit(1)), F.lit(1)).try_cast("double")
    return F.when(value.between(0, 1), value)


def extract_letter(text: Column, letters: Column) -> Column:
    """The last answer letter, or else the last letter that stands alone;
    null if it is not among ``letters``."""
    said = F.try_element_at(F.regexp_extract_all(text, F.lit(ANSWER_LETTER), F.lit(1)), F.lit(-1))
    alone = F.try_element_at(F.regexp_extract_all(text, F.lit(LONE_LETTER), F.lit(1)), F.lit(-1))
    letter = F.upper(F.coalesce(said, alone))
    return F.when(F.array_contains(letters, letter), letter)


def question_hash(question: Column, choices: Column, question_id: Column | None = None, digest: bool = True) -> Column:
    """SHA-256 that identifies a question by its text and sorted choices; or
    the text that is hashed."""
    zero = F.lit("\0")
    listed = F.array_join(F.transform(F.array_sort(F.map_entries(choices)), lambda e: F.concat(e["key"], F.lit("="), e["value"], zero)), "")
    head = F.concat(F.lit("qid:"), question_id, zero) if question_id is not None else F.lit("")
    text = F.concat(head, F.lit("q:"), question, zero, F.lit("choices:"), listed)
    return F.sha2(text, 256) if digest else text


def format_choices(choices: Column) -> Column:
    """'A. text' lines sorted by letter."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(choices)), lambda e: F.concat(e["key"], F.lit(". "), e["value"])), "\n")


def fill(template: str, **fields: Column) -> Column:
    """``template`` with its {name} places filled, all at once: what is filled
    in is not looked through again."""
    parts = re.split("\\{(" + "|".join(map(re.escape, fields)) + ")\\}", template) if fields else [template]
    return F.concat(*[fields[part] if k % 2 else F.lit(part) for k, part in enumerate(parts)])


def prefix_prompts(template: str, question: Column, choices: Column, steps: Column) -> Column:
    """The N + 1 measurement prompts: without reasoning, and after each step."""
    numbered = F.transform(steps, lambda s, i: F.concat(F.lit("Reasoning step "), (i + 1).cast("string"), F.lit(": "), s, F.lit("\n")))
    so_far = lambda n: F.array_join(F.slice(numbered, 1, n), "")
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: fill(template, question=question, choices=format_choices(choices), reasoning_so_far=so_far(n)))


def common_prefix(tokens: Column) -> Column:
    """Length of the longest common prefix of an array of token arrays."""
    shortest = F.array_min(F.transform(tokens, lambda t: F.size(t)))
    same = lambda i: F.forall(tokens, lambda t: F.get(t, i) == F.get(F.get(tokens, F.lit(0)), i))
    flags = F.transform(F.sequence(F.lit(0), shortest - 1), same)
    first = F.array_position(flags, F.lit(False))
    return F.when((F.size(tokens) == 0) | (shortest == 0), F.lit(0)).otherwise(F.when(first > 0, first.cast("int") - 1).otherwise(shortest))


def prompt_version(raw: Column) -> Column:
    """N of the '# version: N' header on the first line that is not blank."""
    found = F.regexp_extract(raw, r"(?U)\A\s*#\s*version:\s*(\d+)[^\n]*(?:\n|\z)", 1)
    return F.when(found == "", F.raise_error(F.lit("no version header")).cast("int")).otherwise(found.try_cast("int"))


def prompt_body(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?U)\A\s*#\s*version:\s*\d+[^\n]*(?:\n|\z)", "")
