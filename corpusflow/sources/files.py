"""Uploaded files: type detection, text extraction, publishing metadata."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import rules
from corpusflow.functions.basic import let
from corpusflow.functions.text import sanitize

DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
TEXT_EXTENSIONS = {
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".markdown": "text/markdown",
    ".csv": "text/csv",
    ".json": "application/json",
    ".log": "text/plain",
}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def sniff_type(content: Column, filename: Column) -> Column:
    """Content type from the first bytes; extension only for valid text.
    NULL means the file is not accepted."""
    head = F.hex(F.substring(content, 1, 16))
    as_latin = F.decode(content, "ISO-8859-1")
    suffix = F.lower(F.regexp_extract(filename, r"(\.[^.]*)$", 1))
    by_suffix = F.element_at(
        F.create_map(*[F.lit(x) for pair in TEXT_EXTENSIONS.items() for x in pair]), suffix
    )
    return (
        F.when(head.startswith("255044462D"), "application/pdf")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("504B0304"), F.when(as_latin.contains("word/document.xml"), F.lit(DOCX)))
        .when(F.is_valid_utf8(content.cast("string")), by_suffix)
    )


def file_kind(content_type: Column) -> Column:
    return F.when(content_type.startswith("image/"), "image").otherwise("document")


@F.pandas_udf(T.StringType())
def _pretty_json(s: pd.Series) -> pd.Series:
    def one(text: str) -> str:
        try:
            return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
        except ValueError:
            return text

    return s.map(one, na_action="ignore")


def pretty_json(text: Column, content_type: Column) -> Column:
    """Indent JSON files; only those rows cross to Python."""
    return F.coalesce(_pretty_json(F.when(content_type == "application/json", text)), text)


def extract_text(df: DataFrame, text: str = "text", content_type: str = "content_type",
                 max_chars: int = rules.EXTRACT_MAX_CHARS) -> DataFrame:
    """Add ``kind``, ``extraction_status``, ``extracted_text``, ``line_count``
    and ``truncated_to_chars`` to decoded text files.

    A NULL text is a file that could not be decoded.
    """
    raw = pretty_json(F.col(text), F.col(content_type))
    out = df.withColumn("_raw", raw)
    out = out.withColumn("_clean", sanitize("_raw"))
    long = F.char_length("_clean") > max_chars
    status = (
        F.when(F.col(content_type).startswith("image/"), "ok")
        .when(F.col("_clean").isNull(), "failed")
        .when(F.col("_clean") == "", "empty")
        .when(long, "truncated")
        .otherwise("ok")
    )
    has_text = status.isin("ok", "truncated")
    return out.select(
        *df.columns,
        file_kind(F.col(content_type)).alias("kind"),
        status.alias("extraction_status"),
        F.when(has_text, F.left("_clean", F.lit(max_chars))).alias("extracted_text"),
        (F.length("_raw") - F.length(F.replace("_raw", F.lit("\n"), F.lit(""))) + 1).alias("line_count"),
        F.when(long, max_chars).alias("truncated_to_chars"),
    )


def _quoted(c: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1")


def sidecar_json(
    df: DataFrame, max_bytes: int = rules.SIDECAR_MAX_BYTES, constants: dict[str, bool] | None = None
) -> DataFrame:
    """Add ``sidecar``: publishing metadata that fits ``max_bytes``.

    Too big: the address goes first, then the title loses 20 characters at a
    time until it fits. The steps are laid out as an array and the first that
    fits is taken.
    """
    title = F.left(F.coalesce("title", F.lit("")), F.lit(300))

    def body(title_: Column, with_url: bool) -> Column:
        values = {
            "title": _quoted(title_),
            "author": _quoted(F.left(F.coalesce("author", F.lit("")), F.lit(200))),
            "source_url": _quoted(F.col("source_url")),
            "host": _quoted(F.col("host")),
            "concept": _quoted(F.col("concept")),
            "open_access": F.col("open_access").cast("string"),
            **{k: F.lit(str(v).lower()) for k, v in (constants or {}).items()},
        }
        fields = [
            F.concat(F.lit(f'"{name}": '), value)
            for name, value in values.items() if with_url or name != "source_url"
        ]
        return F.concat(F.lit('{"metadataAttributes": {'), F.concat_ws(", ", *fields), F.lit("}}"))

    full = body(title, True)
    steps = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda k: F.left(title, F.greatest(F.lit(0), F.char_length(title) - k * 20)),
    )
    fixed = F.octet_length(body(F.lit(""), False)) - 2
    fits = let(fixed, lambda n: F.filter(steps, lambda t: n + F.octet_length(_quoted(t)) <= max_bytes))
    shorter = F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(""))
    return df.withColumn("_short", shorter).withColumn(
        "sidecar", F.when(F.octet_length(full) <= max_bytes, full).otherwise(body(F.col("_short"), False))
    ).drop("_short")


def write_report(df: DataFrame, path: str) -> None:
    """Run report as CSV: row, outcome, note, bytes, url, title."""
    df.select("row", "outcome", "note", "bytes", "url", "title").write.mode("append").option("header", True).csv(path)
