"""Secret scans, DataFrame functions only.

Base kinds are found by pattern. The entropy kind takes candidate strings
(runs of 20 or more characters of the base64 and URL-safe alphabets), slides a
window of 20 characters over each and keeps Shannon's entropy of the window up
to date from character counts: entering and leaving characters change two
counts and two terms of sum(c * log2(c)). The highest window entropy is held
against the threshold of the string's character class. Candidates that an
allow-list pattern matches are suppressed; base spans never are.

Defined cases: a null text counts as empty (no spans); spans of different
kinds may overlap; repeated rows are scanned alike and all returned; a text of
any length is scanned whole; an empty table gives no rows; columns of the input
stay as they are, and ``scan`` refuses a ``result_column`` that is there
already. Spans count code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.hof import let, prefix_sums

KINDS = ("assign", "access", "hex", "entropy")

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # leftmost runs of 20 or more: shorter ones hold no later start that is long enough
HEX = r"[0-9a-f]{24,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20

#: Least window entropy (bits a character) that counts as random, by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.7}

#: Strings that look random and are known not to be secrets.
ALLOW = (r"(?i)example", r"(?i)placeholder", r"(?i)changeme", r"(?i)0123456789", r"(?i)abcdefghij", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[A-Za-z_=-]+$", r"^[0-9_=+/-]+$")

SPAN = "struct<start:bigint,rank:int,end:bigint>"


def _matches(text: Column, pattern: str, keep, rank: int) -> Column:
    """Spans of the kept leftmost non-overlapping matches of ``pattern``."""

    def located(pieces: Column) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        kept = keep(text)
        items = let(
            F.struct(whole.alias("m"), kept.alias("k")),
            lambda z: F.transform(
                z["m"],
                lambda m, i: F.struct(F.char_length(F.get(pieces, i)).cast("long").alias("gap"), F.char_length(m).cast("long").alias("len"), F.get(z["k"], i).alias("ok")),
            ),
        )
        spans = prefix_sums(
            items,
            lambda x: x["gap"] + x["len"],
            lambda at, x: F.struct((at + x["gap"]).alias("start"), F.when(x["ok"], F.lit(rank)).otherwise(F.lit(-1)).alias("rank"), (at + x["gap"] + x["len"]).alias("end")),
            SPAN,
        )
        return F.filter(spans, lambda s: s["rank"] >= 0)

    return let(F.split(text, pattern, -1), lambda p: F.when(F.size(p) > 1, located(p)).otherwise(F.array().cast(f"array<{SPAN}>")))


def _all_of(pattern: str):
    return lambda text: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.lit(True))


def _assign_ok(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda g: F.char_length(g) >= 6)


def window_entropy(s: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy of any ``window`` characters of ``s``
    (of ``ALPHABET``, no shorter than the window)."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def change(c: Column, by: int) -> Column:
        return F.get(terms, c + by) - F.get(terms, c)

    def slide(codes: Column) -> Column:
        first = F.slice(codes, 1, window)
        start = let(
            F.transform(F.sequence(F.lit(0), F.lit(len(ALPHABET) - 1)), lambda j: F.size(F.filter(first, lambda c: c == j))),
            lambda counts: let(
                F.aggregate(counts, F.lit(0.0), lambda a, c: a + F.get(terms, c)),
                lambda total: F.struct(counts.alias("counts"), total.alias("total"), total.alias("least")),
            ),
        )

        def step(a: Column, i: Column) -> Column:
            return let(
                F.struct(F.get(codes, i).alias("new"), F.get(codes, i - window).alias("old")),
                lambda e: let(
                    F.when(e["new"] == e["old"], a["total"]).otherwise(
                        a["total"] + change(F.get(a["counts"], e["new"]), 1) + change(F.get(a["counts"], e["old"]), -1)
                    ),
                    lambda total: F.struct(
                        F.transform(a["counts"], lambda c, j: c + (j == e["new"]).cast("int") - (j == e["old"]).cast("int")).alias("counts"),
                        total.alias("total"),
                        F.least(a["least"], total).alias("least"),
                    ),
                ),
            )

        later = F.when(F.size(codes) > window, F.sequence(F.lit(window), F.size(codes) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(later, start, step, lambda a: F.lit(math.log2(window)) - a["least"] / window)

    return let(F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), slide)


def _random(s: Column) -> Column:
    """Whether candidate ``s`` passes the allow-list and its class's threshold."""
    plain = F.lit(False)
    for pattern in ALLOW:
        plain = plain | s.rlike(pattern)
    known = s.rlike(rf"^{HEX}$") | s.rlike(rf"^{ACCESS}$")
    least = F.when(s.rlike("^[0-9a-fA-F]+$"), F.lit(THRESHOLDS["hex"])).when(s.rlike("^[A-Za-z0-9]+$"), F.lit(THRESHOLDS["alnum"])).otherwise(F.lit(THRESHOLDS["base64"]))
    return F.when(plain | known, F.lit(False)).otherwise(window_entropy(s) >= least)


def _entropy_ok(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), _random)


def spans(text: Column) -> Column:
    """array<struct<start,rank,end>> of all kinds, by start and then kind."""
    text = F.coalesce(text, F.lit(""))
    found = [
        _matches(text, ASSIGN, _assign_ok, 0),
        _matches(text, ACCESS, _all_of(ACCESS), 1),
        _matches(text, HEX, _all_of(HEX), 2),
        _matches(text, CANDIDATE, _entropy_ok, 3),
    ]
    return F.array_sort(F.concat(*found))


def digest(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def scan(docs: DataFrame, text_column: str = "text", result_column: str = "secret_spans") -> DataFrame:
    """``docs`` with ``result_column``: the spans of secrets in each text."""
    if result_column in docs.columns:
        raise ValueError(f"the documents have a column {result_column} already")
    return docs.withColumn(result_column, spans(docs[text_column]))


def redacted(text: Column) -> Column:
    """The text with each secret's value replaced; one pass a kind, in time
    proportional to the text. Null stays null."""

    def replaced(t: Column, pattern: str, put) -> Column:
        def rebuilt(v: Column, pieces: Column) -> Column:
            return F.array_join(F.zip_with(pieces, F.concat(put(v), F.array(F.lit(""))), lambda p, r: F.concat(p, r)), "")

        return let(t, lambda v: let(F.split(v, pattern, -1), lambda p: F.when(F.size(p) > 1, rebuilt(v, p)).otherwise(v)))

    def put_assign(v: Column) -> Column:
        whole, value = (F.regexp_extract_all(v, F.lit(ASSIGN), F.lit(g)) for g in (0, 2))
        return F.zip_with(whole, value, lambda m, g: F.when(F.char_length(g) >= 6, F.concat(F.substr(m, F.lit(1), F.char_length(m) - F.char_length(g)), F.lit("[SECRET]"))).otherwise(m))

    def put_entropy(v: Column) -> Column:
        return F.transform(F.regexp_extract_all(v, F.lit(CANDIDATE), F.lit(0)), lambda m: F.when(_random(m), F.lit("[SECRET]")).otherwise(m))

    text = replaced(text, ASSIGN, put_assign)
    text = F.regexp_replace(text, ACCESS, "[SECRET]")
    text = F.regexp_replace(text, HEX, "[SECRET]")
    return replaced(text, CANDIDATE, put_entropy)


def redact(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the secrets in ``text_column`` replaced by [SECRET]."""
    return docs.withColumn(text_column, redacted(docs[text_column]))
