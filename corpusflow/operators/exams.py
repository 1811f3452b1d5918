"""Exam sampling and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(seed: int | str, *parts: Column) -> Column:
    """A portable pseudo-random order: the digest of seed and id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]).cast("binary"))


def mix_questions(
    bank: DataFrame, n: int, seed: int, group: Sequence[str] = ("board", "subject"), year: str = "year",
    question: str = "question_id", years: Sequence[int] | None = None,
) -> DataFrame:
    """Up to ``n`` questions per board and subject, drawn evenly over the years.

    Shuffle within the year, deal one question per year in ascending order until
    ``n`` are dealt, shuffle what was dealt. No year can contribute more than
    ``n``, so that rank is cut before the shuffle.
    """
    pool = bank if not years else bank.where(F.col(year).isin(*years))
    in_year = Window.partitionBy(*group, year).orderBy(seeded_order(seed, F.col(question)), question)
    dealt = Window.partitionBy(*group).orderBy("_round", year)
    shown = Window.partitionBy(*group).orderBy(seeded_order(f"{seed}:order", F.col(question)), question)
    return (
        pool.withColumn("_round", F.row_number().over(in_year))
        .where(f"_round <= {n}")
        .withColumn("_deal", F.row_number().over(dealt))
        .where(f"_deal <= {n}")
        .withColumn("position", F.row_number().over(shown) - 1)
        .drop("_round", "_deal")
    )


def requested_delivered(picked: DataFrame, n: int, group: Sequence[str] = ("board", "subject")) -> DataFrame:
    return picked.groupBy(*group).agg(F.lit(n).alias("requested"), F.count("*").alias("delivered"))


def mark_answers(session_questions: DataFrame, bank: DataFrame, question: str = "question_id") -> DataFrame:
    """Adds ``correct_option`` and ``is_correct``; no answer is a wrong answer."""
    key = bank.select(question, "correct_option")
    correct = F.col("selected_option").eqNullSafe(F.col("correct_option")) & F.col("selected_option").isNotNull()
    return session_questions.join(key, question).withColumn("is_correct", correct)


def exam_scores(sessions: DataFrame, marked: DataFrame, session: str = "session_id") -> DataFrame:
    """Score in percent, halves to even; a session without questions scores 0."""
    sums = marked.groupBy(session).agg(
        F.count_if("is_correct").alias("correct"), F.count("*").alias("total")
    )
    correct, total = F.coalesce("correct", F.lit(0)), F.coalesce("total", F.lit(0))
    return sessions.join(sums, session, "left").select(
        *sessions.columns,
        correct.alias("correct"),
        total.alias("total"),
        F.bround(100 * correct / F.greatest(total, F.lit(1)), 0).cast("int").alias("score"),
    )


def corrections(marked: DataFrame) -> DataFrame:
    return marked.where("NOT is_correct")
