"""Registration, table access and the frames several queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.html import html_title
from corpusflow.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say it, its oracle."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table up to this size may be dealt out anew for work-heavy columns.
SPREAD_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on work-heavy columns of a table that is one small file.

    The size of the table decides alone: a larger one is returned as it is, however
    many cores there are, so it is never shuffled for this.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


def capitalised(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substr(c, F.lit(2)))


def named_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with language, title and an author name taken from the address."""
    label = F.regexp_extract("url", r"^https?://(?:www\.|m\.|blog\.)?([a-z\-]+)", 1)
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id", "url", "html",
        F.regexp_extract("url", r"^https?://[^/]*/([a-z]+)/", 1).alias("lang"),
        F.trim(html_title("html")).alias("title"),
        capitalised(F.replace(label, F.lit("-"), F.lit(""))).alias("family"),
    ).withColumn("given", F.concat(capitalised(F.col("lang")), F.lit("an")))


#: The same frame for the oracle.
SQL_NAMED_PAGES = r"""
 named AS (
  SELECT page_id, url, html,
         regexp_extract(url, '^https?://[^/]*/([a-z]+)/', 1) AS lang,
         trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
         replace(regexp_extract(url, '^https?://(?:www\.|m\.|blog\.)?([a-z\-]+)', 1), '-', '') AS lab
  FROM pages),
 np AS (
  SELECT page_id, url, html, lang, title,
         upper(left(lab, 1)) || substr(lab, 2) AS family,
         upper(left(lang, 1)) || substr(lang, 2) || 'an' AS given
  FROM named)
"""

_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def sql_part(u: str, group: int) -> str:
    return f"regexp_extract({u}, '{_URI}', {group})"


def sql_domain(u: str) -> str:
    return rf"regexp_replace(split_part(lower({sql_part(u, 2)}), ':', 1), '^www\.', '')"


def sql_url_key(u: str) -> str:
    host = rf"regexp_replace(regexp_replace(regexp_replace(lower({sql_part(u, 2)}), '^www\.', ''), ':80$', ''), ':443$', '')"
    q = (
        f"array_to_string(list_filter(string_split({sql_part(u, 4)}, '&'), "
        "lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_|fbclid|gclid|_ga|ref=)')), '&')"
    )
    path = f"regexp_replace({sql_part(u, 3)}, '(.)/$', '\\1')"
    return (
        f"(CASE WHEN {sql_part(u, 1)} <> '' AND {sql_part(u, 2)} <> '' THEN lower({sql_part(u, 1)}) || '://' || {host} || {path} "
        f"|| CASE WHEN {q} <> '' THEN '?' || {q} ELSE '' END ELSE trim({u}) END)"
    )


def sql_words(t: str) -> str:
    """Lower-case [a-z0-9] words joined by blanks."""
    return f"trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'))"


def sql_strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def sql_sanitize(t: str) -> str:
    out = rf"regexp_replace(nfc_normalize({t}), '[\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}\x00-\x08\x0b-\x1f\x7f-\x{{9f}}\x{{ad}}]', '', 'g')"
    out = rf"regexp_replace({out}, '(?i)</?\s*(retrieved_sources|user_attachments)\s*>', '[quoted-tag]', 'g')"
    out = rf"regexp_replace({out}, '(?i)</?\s*(system|assistant|instructions?)\s*>|\[/?(SYSTEM|INST)\]|<\|[a-z_]+\|>', '[quoted-tag]', 'g')"
    out = rf"regexp_replace({out}, '[ \t]{{3,}}', '  ', 'g')"
    out = rf"regexp_replace({out}, '\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')"
    return sql_strip(out)
