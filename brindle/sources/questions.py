"""Question sources as tables: id, question, choices, answer letter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS = ["A", "B", "C", "D"]


def multiple_choice(rows: DataFrame, split: str, index: str = "row_index") -> DataFrame:
    """Rows with a letter-keyed options map and an answer letter. The id comes
    from the stored row index; the answer must be among the options."""
    ok = F.array_contains(F.map_keys("options"), F.col("answer_idx")) & (F.size("options") > 0)
    answer = F.when(ok, F.col("answer_idx")).otherwise(F.raise_error(F.lit("the answer is not among the options")))
    return rows.select(
        F.concat(F.lit(f"medqa-{split}-"), F.col(index).cast("string")).alias("question_id"),
        "question",
        F.col("options").alias("choices"),
        answer.alias("answer_letter"),
        (F.col("meta_info") if "meta_info" in rows.columns else F.lit(None).cast("string")).alias("usmle_step"),
    )


def subject_questions(rows: DataFrame, subject: str, split: str, index: str = "row_index") -> DataFrame:
    """Rows with a list of four choices and an answer number, as letters."""
    four = (F.size("choices") == 4) & F.col("answer").between(0, 3)
    letter = F.when(four, F.get(F.array(*map(F.lit, LETTERS)), F.col("answer"))).otherwise(F.raise_error(F.lit("four choices and an answer from 0 to 3 are needed")))
    return rows.where(F.col("subject") == subject).select(
        F.concat(F.lit(f"mmlu-{subject}-{split}-"), F.col(index).cast("string")).alias("question_id"),
        "question",
        F.map_from_arrays(F.array(*map(F.lit, LETTERS)), F.col("choices")).alias("choices"),
        letter.alias("answer_letter"),
    )


def answer_key(questions: DataFrame) -> DataFrame:
    """The gold outcome of each question."""
    return questions.select(F.col("question_id").alias("trajectory_id"), F.col("answer_letter").alias("primary_label"), F.lit(1.0).alias("confidence"), F.create_map(F.lit("question_id"), F.col("question_id")).alias("secondary_labels"))


def with_outcome(trajectories: DataFrame, outcomes: DataFrame) -> DataFrame:
    return trajectories.join(outcomes, "trajectory_id", "left")


def first_records(rows: DataFrame, n: int, order: str) -> DataFrame:
    """The first ``n`` rows by ``order``, alike in every run."""
    if n < 0:
        raise ValueError("the number of records must not be negative")
    return rows.orderBy(order).limit(n)


def profile(questions: DataFrame) -> DataFrame:
    """section, key, value: what a table of questions holds. Sections: size;
    choices (how many questions have so many); meta and answer (counts of the
    values); length (of questions: min, max, mean, median); mismatch (answers
    that are not among the choices, choices without text)."""
    from brindle.operators.ordered import quantiles

    meta = F.col("usmle_step") if "usmle_step" in questions.columns else F.lit(None).cast("string")
    told = questions.select(F.size("choices").alias("k"), meta.alias("meta"), F.col("answer_letter").alias("answer"), F.char_length("question").alias("n"), "choices")
    counted = lambda section, key: told.groupBy(key.cast("string").alias("key")).agg(F.count("*").cast("double").alias("value")).select(F.lit(section).alias("section"), F.coalesce("key", F.lit("none")).alias("key"), "value")
    lost = ~F.coalesce(F.array_contains(F.map_keys("choices"), F.col("answer")), F.lit(False))
    blank = F.exists(F.map_values("choices"), lambda x: F.coalesce(F.trim(x) == "", F.lit(True)))
    keyed = told.withColumn("_k", F.lit(0))
    base = keyed.groupBy("_k").agg(F.count("*").alias("n_all"), F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.sum(lost.cast("int")).alias("answer"), F.sum(blank.cast("int")).alias("blank"))
    wide = base.join(quantiles(keyed, ["_k"], "n", {"median": 0.5}), "_k")
    row = lambda section, key, column: F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), F.col(column).cast("double").alias("value"))
    single = wide.select(F.inline(F.array(row("size", "questions", "n_all"), *[row("length", x, x) for x in ("min", "max", "mean", "median")], row("mismatch", "answer", "answer"), row("mismatch", "blank choice", "blank"))))
    return single.unionByName(counted("choices", F.col("k"))).unionByName(counted("meta", F.col("meta"))).unionByName(counted("answer", F.col("answer")))
