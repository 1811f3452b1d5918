"""Readable titles from page titles and addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions.basic import (
    alternation, col, collapse, nullif_blank, percent_decode, strip, title_case,
)
from corpusflow.functions.urls import source_domain, url_path


def file_stem(url: Column | str) -> Column:
    """Last path component without its extension, separators as blanks."""
    last = F.regexp_extract(percent_decode(url_path(url)), r"([^/]+)/*$", 1)
    stem = F.regexp_replace(last, r"(?s)^(.+)\.[^.]+$", "$1")
    return collapse(F.regexp_replace(stem, r"[_\-+.]+", " "))


def clean_title(
    raw: Column | str, url: Column | str, boilerplate: Sequence[str] = rules.TITLE_BOILERPLATE
) -> Column:
    """Drop engine marks, repository boilerplate, site branding and dangling
    ellipses; fall back to the file name, then the host."""
    text = collapse(raw)
    text = strip(F.regexp_replace(text, rules.TITLE_FILE_MARK, ""))
    text = F.regexp_replace(text, r"^[ \-|–—·:]+|[ \-|–—·:]+$", "")
    # up to four exact boilerplate segments at the end
    tail = rf"(?i)(?:\s*[:|–—]\s*(?:{alternation(boilerplate)})\s*){{1,4}}$"
    text = strip(F.regexp_replace(text, tail, ""))
    text = F.when(F.char_length(text) > 60, F.regexp_replace(text, rules.TITLE_BRANDING, "")).otherwise(text)
    text = strip(F.regexp_replace(text, rules.TITLE_ELLIPSIS, ""))
    text = strip(F.regexp_replace(text, r"^[:|–—]+|[:|–—]+$", ""))
    fallback = F.coalesce(
        nullif_blank(title_case(file_stem(url))), nullif_blank(source_domain(url)), F.lit("Untitled document")
    )
    return F.left(F.when(F.char_length(text) < 5, fallback).otherwise(text), F.lit(500))


def unwrap_full_text_title(title: Column | str) -> Column:
    """``Full text of "X"`` becomes ``X``."""
    return F.regexp_replace(F.coalesce(col(title), F.lit("")), rules.FULL_TEXT_TITLE, "$1")
