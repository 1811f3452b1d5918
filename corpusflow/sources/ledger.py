"""The discovery ledger: scan, validation, pending work, guarded write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.basic import collapse, strip
from corpusflow.functions.urls import is_http

LEDGER_COLUMNS = (
    "subject", "source", "hyperlink", "title", "open_source", "authors", "verdict", "downloaded", "note",
)
LEDGER_SCHEMA = ", ".join(f"{c} string" for c in LEDGER_COLUMNS)


def tidy_cells(df: DataFrame) -> DataFrame:
    """All ledger columns as trimmed strings; a missing trailing cell is ''."""
    cells = [
        strip(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c in df.columns else F.lit("").alias(c)
        for c in LEDGER_COLUMNS
    ]
    extra = [c for c in df.columns if c not in LEDGER_COLUMNS]
    return df.select(*extra, *cells)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """CSV ledger with a header row; old sheets may lack the last columns."""
    raw = (
        spark.read.schema(LEDGER_SCHEMA)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("enforceSchema", True)
        .csv(path)
    )
    return tidy_cells(raw)


def flag(cell: Column) -> Column:
    """Tri-state cell: TRUE, FALSE, or NULL when blank."""
    upper = F.upper(strip(cell))
    return F.when(upper == "TRUE", True).when(upper == "FALSE", False)


def pending_rows(ledger: DataFrame, retry_failed: bool = False, limit: int | None = None) -> DataFrame:
    """Rows approved for download and not yet done or given up."""
    todo = (
        F.coalesce(flag(F.col("verdict")), F.lit(False))
        & ~F.coalesce(flag(F.col("downloaded")), F.lit(False))
        & is_http("hyperlink")
    )
    if not retry_failed:
        todo = todo & ~F.col("note").startswith("failed:")
    out = ledger.where(todo)
    return out if limit is None else out.limit(limit)


def missing_authors(ledger: DataFrame) -> DataFrame:
    return ledger.where(is_http("hyperlink") & (strip(F.coalesce(F.col("authors"), F.lit(""))) == ""))


def skip_published(rows: DataFrame, published: DataFrame, key: str = "object_key") -> DataFrame:
    return rows.join(published.select(key).distinct(), key, "left_anti")


def validate_rows(df: DataFrame) -> DataFrame:
    """Tidy candidate rows and add ``reject_reason`` (NULL when the row is good)."""
    blank_to_unknown = lambda c: F.coalesce(F.nullif(collapse(c), F.lit("")), F.lit("Unknown"))
    out = df.withColumns(
        {
            "subject": blank_to_unknown("subject"),
            "source": blank_to_unknown("source"),
            "title": blank_to_unknown("title"),
            "authors": collapse("authors"),
        }
    )
    size = lambda c: F.char_length(F.coalesce(F.col(c), F.lit("")))
    reason = (
        F.when(size("subject") > 200, "subject_too_long")
        .when(size("source") > 200, "source_too_long")
        .when(size("title") > 500, "title_too_long")
        .when(size("authors") > 1000, "authors_too_long")
        .when(~size("hyperlink").between(8, 2000), "bad_url_length")
        .when(~is_http("hyperlink"), "not_http")
    )
    return out.withColumn("reject_reason", reason)


def guarded_backfill(ledger: DataFrame, updates: DataFrame, target: str) -> DataFrame:
    """Fill blank ``target`` cells from ``updates(row_no, hyperlink, value)``.

    A row that now holds another address than the one the update was computed
    for is left alone. ``outcome`` tells what happened to each ledger row.
    """
    u = updates.select("row_no", F.col("hyperlink").alias("_url"), F.col("value").alias("_value"))
    blank = strip(F.coalesce(F.col(target), F.lit(""))) == ""
    offered, same = F.col("_value").isNotNull(), F.col("hyperlink") == F.col("_url")
    outcome = (
        F.when(~offered, "no_update").when(~same, "skipped_moved").when(~blank, "kept").otherwise("written")
    )
    joined = ledger.join(u, "row_no", "left").withColumn("outcome", outcome)
    value = F.when(F.col("outcome") == "written", F.col("_value")).otherwise(F.col(target))
    return joined.withColumn(target, value).drop("_url", "_value")
