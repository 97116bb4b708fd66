"""Line-first quality rules, DataFrame functions only.

Each line with words is held against rules, whatever its length:

* punctuation: a line of fewer than ``SENTENCE`` words must end as a sentence
  or quotation does, or it is a heading, caption or menu entry;
* shouting: four words or more, capitals and no small letter;
* symbols: more of them than words;
* navigation: three separators or more, four words or fewer to each, or
  nothing but an address;
* boilerplate: licence, copyright, cookie, terms and subscription phrases, in
  the corpus's four languages.

Failing lines go, and a document that loses more than ``max_loss`` of its word
characters is rejected. Statistics over the whole text (words, repeated windows
and lines) come beside them.

Everything about a document is computed within its row, so nothing is
shuffled and no group can be hot. Repeated windows are found by sorting
(hash, position) pairs of a row's windows, which takes n log n steps; two
different windows of one text count as repeated if their 64-bit hashes are
equal, once in 10**10 texts of 50,000 words or so.

Defined cases: a null text counts as empty: zero statistics, base_failed,
not kept, its cleaned text stays null; a text of any length is judged whole;
repeated rows are judged alike and all returned; an empty table gives no rows;
input columns stay as they are and the results sit in one struct column named
by ``result_column``, which must not be among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.hof import count_chars, let

SPACE = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD_CHAR = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Words from which a line needs no end of a sentence.
SENTENCE = 8
SENTENCE_END = r"""[.!?…:;。！？：；"'”’»)\]]$"""
SEPARATORS = "|»›·•→>"
ADDRESS = r"^(?:https?://|www\.)\S+$"

# Phrases of licences, notices and calls to click, in English,
# French, German and Spanish.
BOILERPLATE = (
    "all rights reserved",
    "licensed under ",
    "released under the",
    "this work is licensed",
    "cookie policy",
    "privacy policy",
    "terms of service",
    "terms of use",
    "click here",
    "subscribe to our newsletter",
    "javascript is disabled",
    "enable javascript",
    "tous droits réservés",
    "publié sous licence",
    "politique de confidentialité",
    "politique de cookies",
    "conditions d'utilisation",
    "mentions légales",
    "cliquez ici",
    "abonnez-vous à notre",
    "alle rechte vorbehalten",
    "lizenziert unter",
    "datenschutzerklärung",
    "nutzungsbedingungen",
    "cookie-richtlinie",
    "hier klicken",
    "newsletter abonnieren",
    "todos los derechos reservados",
    "bajo la licencia",
    "política de privacidad",
    "política de cookies",
    "condiciones de uso",
    "aviso legal",
    "haga clic aquí",
    "suscríbase a nuestro",
    "©",
    "copyright (c)",
)


def words_of(text: Column) -> Column:
    """The words of a non-null text; no words: an empty array."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return let(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN, -1)))


def window_hashes(words: Column, window: int) -> Column:
    """A hash of each ``window`` consecutive words, of at least so many: from
    hashes of words to those of two, four and so on, and one last step that
    overlaps where ``window`` is no power of two."""
    level, span = F.transform(words, lambda w: F.xxhash64(w)), 1

    def joined(hashes: Column, by: int) -> Column:
        return let(hashes, lambda x: F.transform(F.slice(x, 1, F.size(x) - by), lambda h, i: F.xxhash64(h, F.get(x, i + by))))

    while span < window:
        by = min(span, window - span)
        level, span = joined(level, by), span + by
    return level


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that occur twice or
    more in ``words``. Windows are told apart by a 64-bit hash."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def doubled(p: Column) -> Column:
            same = lambda a, b: F.get(p, a)["h"] == F.get(p, b)["h"]
            marked = F.transform(p, lambda x, k: F.when(F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)), x["i"]).otherwise(F.lit(-1)))
            return F.sort_array(F.filter(marked, lambda i: i >= 0))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(at, k + 1) - i, F.lit(window))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(let(pairs, doubled), total)

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(
        let(window_hashes(words, window), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def line_ok(line: Column) -> Column:
    """Whether a line stays. Lines without a word always do."""

    def judged(v: Column) -> Column:
        text, n = v["line"], v["n"]
        without = text
        for mark in SEPARATORS:
            without = F.replace(without, F.lit(mark), F.lit(""))
        bars = (F.char_length(text) - F.char_length(without)).cast("long")
        navigation = let(bars, lambda b: (b >= 3) & (b * 4 >= n)) | ((n == 1) & text.rlike(ADDRESS))
        symbols = count_chars(text, SYMBOLS) > n
        shouting = (n >= 4) & ~text.rlike(r"\p{Ll}") & text.rlike(r"\p{Lu}")
        unfinished = (n < SENTENCE) & ~text.rlike(SENTENCE_END)

        def boilerplate(low: Column) -> Column:
            found = F.lit(False)
            for phrase in BOILERPLATE:
                found = found | F.contains(low, F.lit(phrase))
            return found

        return F.when(text == "", F.lit(True)).when(shouting | unfinished | navigation | symbols, F.lit(False)).otherwise(~let(F.lower(text), boilerplate))

    def words(t: Column) -> Column:
        """Of a trimmed line; plain counting where single spaces part them."""
        odd = F.contains(t, F.lit("  "))
        for mark in SPACE[1:]:
            odd = odd | F.contains(t, F.lit(mark))
        return F.when(odd, F.regexp_count(t, F.lit(SPACE_RUN)).cast("long")).otherwise(count_chars(t, " ")) + 1

    trimmed = F.btrim(line, F.lit(SPACE))
    return let(trimmed, lambda t: let(F.struct(t.alias("line"), words(t).alias("n")), judged))


def word_chars(text: Column) -> Column:
    """Code points of ``text`` inside words."""
    return F.char_length(text).cast("long") - count_chars(text, SPACE)


def rules(text: Column, max_loss: float = 0.5) -> Column:
    """struct of statistics, verdicts and the cleaned text."""

    def judged(t: Column) -> Column:
        lines = F.split(t, "\n", -1)
        with_words = F.filter(lines, lambda x: x.rlike(WORD_CHAR))
        cleaned = F.array_join(F.filter(lines, line_ok), "\n")
        counts = F.struct(
            let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_window_words(w).alias("n_repeat_words"))).alias("w"),
            word_chars(t).alias("word_chars"),
            count_chars(t, SYMBOLS).alias("n_symbols"),
            let(with_words, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            cleaned.alias("cleaned"),
        )

        def verdict(c: Column) -> Column:
            n, repeats = c["w"]["n_words"], c["w"]["n_repeat_words"]
            failed = (n < 20) | (100 * repeats > 30 * n)
            loss = 1 - F.try_divide(word_chars(c["cleaned"]), c["word_chars"])
            return F.struct(
                n.alias("n_words"),
                c["word_chars"].alias("word_chars"),
                c["n_symbols"].alias("n_symbols"),
                c["n_dup_lines"].alias("n_dup_lines"),
                repeats.alias("n_repeat_words"),
                failed.alias("base_failed"),
                (~failed & (F.coalesce(loss, F.lit(1.0)) <= max_loss)).alias("kept"),
                c["cleaned"].alias("cleaned"),
            )

        return let(counts, verdict)

    return let(F.coalesce(text, F.lit("")), judged)


def judge(docs: DataFrame, text_column: str = "text", result_column: str = "quality", max_loss: float = 0.5) -> DataFrame:
    """``docs`` with the struct of ``rules`` as ``result_column``."""
    if result_column in docs.columns:
        raise ValueError(f"the documents have a column {result_column} already")
    return docs.withColumn(result_column, rules(docs[text_column], max_loss))


def clean(docs: DataFrame, text_column: str = "text", max_loss: float = 0.5) -> DataFrame:
    """The kept documents of ``docs`` with their failing lines removed."""
    # A generator runs the rules once; a filter on their result would run them
    # for the filter and again for the text.
    once = F.explode(F.filter(F.array(rules(docs[text_column], max_loss)), lambda q: q["kept"])).alias("q")
    held = docs.select(F.struct("*").alias("row"), once)
    return held.select(*[F.col("q.cleaned").alias(c) if c == text_column else F.col(f"row.`{c}`") for c in docs.columns])
