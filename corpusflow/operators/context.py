"""Prompt rows: retrieved context, attachments, templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions.text import sanitize

CONTEXT_TEMPLATE = "Sources:\n<retrieved_sources>\n{context}\n</retrieved_sources>\n\nQuestion:\n{question}"
ATTACHMENT_TEMPLATE = "Files:\n<user_attachments>\n{attachments}\n</user_attachments>"


def _joined_in_order(position: str, block: Column) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(position), block.alias("block"))))
    return F.array_join(F.transform(rows, lambda r: r["block"]), "\n\n")


def render_context(hits: DataFrame, by: Sequence[str], rank: str = "rank") -> DataFrame:
    """Numbered, citable source blocks per question.

    Groups are the top-k of one question, so they are small by construction.
    """
    safe = hits.select(
        *by, rank, sanitize("title").alias("_t"), sanitize("category").alias("_c"), sanitize("content").alias("_b")
    )
    block = F.concat(
        F.lit("[Source "), F.col(rank).cast("string"), F.lit(": "), F.col("_t"), F.lit(" | category: "), F.col("_c"),
        F.lit("]\n"), F.col("_b"),
    )
    return safe.groupBy(*by).agg(_joined_in_order(rank, block).alias("context"))


def attachment_block(images_visible: bool = True) -> Column:
    """Body of one attachment ``(kind, extraction_status, extracted_text)``."""
    image = rules.IMAGE_VISIBLE_NOTE if images_visible else rules.IMAGE_HIDDEN_NOTE
    status, text = F.col("extraction_status"), F.coalesce("extracted_text", F.lit(""))
    return (
        F.when(F.col("kind") == "image", F.lit(image))
        .when(status.isin("failed", "unsupported"), F.lit(rules.UNREADABLE_NOTE))
        .when(status == "empty", F.lit(rules.EMPTY_FILE_NOTE))
        .when(status == "truncated", F.concat(text, F.lit(rules.TRUNCATED_NOTE)))
        .otherwise(text)
    )


def render_attachments(attachments: DataFrame, by: Sequence[str], position: str = "position",
                       images_visible: bool = True, most: int = rules.UPLOAD_MAX_PER_MESSAGE) -> DataFrame:
    """Manifest of a message's attachments; a message carries at most ``most``, those at its first positions."""
    block = F.concat(
        F.lit("[Attachment "), (F.col(position) + 1).cast("string"), F.lit(": "), F.col("filename"), F.lit("]\n"),
        attachment_block(images_visible),
    )
    first = Window.partitionBy(*by).orderBy(F.col(position), F.col("filename"))
    carried = attachments.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= most)
    return carried.groupBy(*by).agg(_joined_in_order(position, block).alias("attachments"))


def fill(template: str, **slots: Column) -> Column:
    """Fill ``{name}`` slots; what fills them is never scanned for slots."""
    out, rest = [], template
    while rest:
        at = [(rest.index(f"{{{name}}}"), name) for name in slots if f"{{{name}}}" in rest]
        if not at:
            out.append(F.lit(rest))
            break
        i, name = min(at)
        out += [F.lit(rest[:i]), slots[name]]
        rest = rest[i + len(name) + 2 :]
    return F.concat(*out)


def prompt_row(
    question: Column, context: Column, attachments: Column | None = None,
    context_template: str = CONTEXT_TEMPLATE, attachment_template: str = ATTACHMENT_TEMPLATE,
) -> Column:
    filled = F.when(F.coalesce(context, F.lit("")) == "", F.lit(rules.NO_SOURCES_NOTE)).otherwise(context)
    body = fill(context_template, context=filled, question=question)
    if attachments is None:
        return body
    prefix = fill(attachment_template, attachments=attachments)
    return F.when(F.coalesce(attachments, F.lit("")) == "", body).otherwise(F.concat(prefix, F.lit("\n\n"), body))
