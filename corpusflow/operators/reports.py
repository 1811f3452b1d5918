"""Counts and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.operators.ordered import SEGMENT, running_all, with_segment


def used_bytes(users: DataFrame, uploads: DataFrame, user: str = "user_id", size: str = "size_bytes") -> DataFrame:
    sums = uploads.groupBy(user).agg(F.sum(size).alias("used_bytes"))
    return users.join(sums, user, "left").withColumn("used_bytes", F.coalesce("used_bytes", F.lit(0)))


def outcome_label(note: Column, downloaded: Column) -> Column:
    return F.when(downloaded, "downloaded").otherwise(F.substring_index(note, ":", 1))


def run_outcomes(results: DataFrame) -> DataFrame:
    """``results(downloaded, note, bytes)`` -> rows and bytes per outcome."""
    return results.groupBy(outcome_label(F.col("note"), F.col("downloaded")).alias("outcome")).agg(
        F.count("*").alias("n"), F.sum("bytes").alias("bytes")
    )


def token_usage(messages: DataFrame, *by: str) -> DataFrame:
    prompt, completion = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    return messages.groupBy(*by).agg(
        F.sum(prompt).alias("prompt_tokens"),
        F.sum(completion).alias("completion_tokens"),
        F.sum(prompt + completion).alias("total_tokens"),
    )


def label_counts(labelled: DataFrame) -> DataFrame:
    """Judged rows per verdict, undecided ones as ``unsure``."""
    judged = labelled.where("label_state <> 'unseen'")
    return judged.groupBy(F.coalesce(F.col("verdict").cast("string"), F.lit("unsure")).alias("label")).agg(
        F.count("*").alias("n")
    )


def discovery_funnel(hits: DataFrame, width: int = 10_000) -> DataFrame:
    """Stages per query plus running totals in query order.

    ``hits(query_no, concept, promising, fresh, verified, added)``; a later
    stage only counts rows that passed the ones before.
    """
    p = F.col("promising")
    fresh = p & F.col("fresh")
    verified = fresh & F.col("verified")
    per_query = hits.groupBy("query_no", "concept").agg(
        F.count("*").alias("results"),
        F.count_if(~p).alias("prefiltered"),
        F.count_if(fresh).alias("fresh"),
        F.count_if(verified).alias("verified"),
        F.count_if(verified & F.col("added")).alias("added"),
    )
    cut = with_segment(per_query, F.col("query_no"), width).withColumn("_all", F.lit(0))
    order = [F.col("query_no"), F.col("concept")]
    totals = {"total_queries": F.lit(1), "total_added": F.col("added")}
    return running_all(cut, ["_all"], order, totals).drop("_all", SEGMENT)


def source_progress(pages: DataFrame) -> DataFrame:
    """``pages(source, concept_index, page, records)`` -> how far each source got."""
    return pages.groupBy("source").agg(
        F.max("concept_index").alias("concept_index"),
        F.max_by("page", F.struct("concept_index", "page")).alias("page"),
        F.count("*").alias("pages"),
        F.sum("records").alias("records"),
    )
