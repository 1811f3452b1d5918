"""What to search for, and what the searches brought."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions.html import citation_pdf_url, html_title
from corpusflow.functions.text import is_relevant
from corpusflow.functions.titles import clean_title
from corpusflow.functions.urls import is_open_access, resolve_href, source_domain
from corpusflow.operators.exams import seeded_order
from corpusflow.operators.joins import dealt_join
from corpusflow.operators.windows import first_wins


def query_matrix(concepts: DataFrame, templates: DataFrame, rows_per_task: int = 1_000_000) -> DataFrame:
    """Every concept with every template of its category, as a search string. A large category is dealt over tasks."""
    return dealt_join(concepts, templates, ["category"], rows_per_task).select(
        "category", "concept", F.concat(F.lit('"'), "concept", F.lit('" '), "template").alias("query")
    )


def digest_number(digest: Column) -> Column:
    """The first 32 bits of a hex digest as a number."""
    return F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")


def cycle_plan(matrix: DataFrame, cycle: int, modifiers: Sequence[str] = rules.QUERY_MODIFIERS) -> DataFrame:
    """One full pass: categories and queries in an order that depends on the
    cycle, each query with a rotating modifier. Sort by the two order columns."""
    slot = (digest_number(seeded_order(f"{cycle}:modifier", F.col("query"))) + cycle) % len(modifiers)
    modifier = F.element_at(F.array(*[F.lit(m) for m in modifiers]), (slot + 1).cast("int"))
    return matrix.select(
        "category",
        "concept",
        F.trim(F.concat("query", F.lit(" "), modifier)).alias("query"),
        seeded_order(cycle, F.col("category")).alias("category_order"),
        seeded_order(cycle, F.col("category"), F.col("query")).alias("query_order"),
    )


def build_documents(hits: DataFrame, concept: str = "concept", url: str = "url", html: str = "html",
                    hit_title: str | None = None, snippet: str | None = None) -> DataFrame:
    """Ledger candidates from probed hits: title, relevance gate, access flag."""
    page_title = html_title(html)
    raw = F.when(page_title != "", page_title)
    raw = F.coalesce(raw, F.col(hit_title)) if hit_title else raw
    titled = hits.withColumn("title", clean_title(raw, url))
    body = F.col(snippet) if snippet else None
    return titled.where(is_relevant(concept, F.col("title"), F.col(url), body)).withColumns(
        {"source": source_domain(url), "open_source": is_open_access(url)}
    )


def prefer_file(html: Column | str, url: Column | str) -> Column:
    """The file a landing page declares, else the page itself."""
    return F.coalesce(citation_pdf_url(html), F.col(url) if isinstance(url, str) else url)


def link_candidates(pages: DataFrame, links: Column, key: str = "page_id", url: str = "url",
                    most: int = rules.MAX_CANDIDATES) -> DataFrame:
    """Resolved, distinct links of each page in order, at most ``most``.

    Links of one page are an array of that page's row, so order, deduplication
    and the cut need no shuffle.
    """
    found = pages.select(key, F.col(url).alias("_base"), links.alias("_links"))
    href = lambda x: F.replace(F.trim(x["href"]), F.lit("&amp;"), F.lit("&"))
    resolved = F.transform(
        "_links", lambda x: F.struct(resolve_href(F.col("_base"), href(x)).alias("link"), x["trusted"].alias("trusted"))
    )
    found = found.withColumn("_r", F.filter(resolved, lambda x: x["link"].rlike("^https?://")))
    seen = F.array_distinct(F.transform("_r", lambda x: x["link"]))
    first = F.transform(
        F.slice(seen, 1, most),
        lambda link: F.element_at(F.filter("_r", lambda x: x["link"] == link), 1),
    )
    return found.select(key, F.posexplode(first).alias("rank", "_c")).select(
        key, (F.col("rank") + 1).alias("rank"), "_c.link", "_c.trusted"
    )


def union_channels(*channels: DataFrame) -> DataFrame:
    """Records of all discovery channels; a channel may lack columns."""
    out = channels[0]
    for other in channels[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def cap_pages(pages: DataFrame, most: int = rules.MAX_PAGES_PER_CONCEPT) -> DataFrame:
    """Catalogue pages within the per-concept page limit."""
    return pages.where(F.col("page") <= most)


def first_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    return first_wins(df, [key], [order])
