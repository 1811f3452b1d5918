"""Address and page-source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import html as H
from corpusflow.functions import urls as U
from corpusflow.functions.titles import clean_title
from corpusflow.operators.discovery import link_candidates
from corpusflow.plans.common import (
    SQL_NAMED_PAGES, named_pages, query, sql_domain, sql_part, sql_url_key, table,
)

# The sample pages live on example hosts, so the rules get example values.
OPEN = ("example.org",)
CLOSED = ("blog.tionsh.example.net", "example.com")
BLOCKED = ("cheap-pills", "casino")
ITEMS = (r"/(?:en|fr)/\d+", r"[?&]page=\d+")


@query("normalise_url", f"SELECT page_id, {sql_url_key('url')} AS url_key FROM pages")
def normalise_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalise_url("url").alias("url_key"))


@query("source_domain", f"SELECT page_id, {sql_domain('url')} AS source FROM pages")
def source_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.source_domain("url").alias("source"))


@query(
    "open_access",
    rf"""
    WITH p AS (SELECT page_id, {sql_domain('url')} AS host FROM pages)
    SELECT page_id,
      CASE WHEN host = '' THEN false
           WHEN regexp_matches(host, '(^|\.)(blog\.tionsh\.example\.net|example\.com)$') THEN false
           WHEN regexp_matches(host, '(^|\.)example\.org$') THEN true
           ELSE ends_with(host, 'th.example.net') END AS open_source
    FROM p""",
)
def open_access(spark, sf_dir):
    flag = U.is_open_access("url", open_domains=OPEN, closed_domains=CLOSED, open_suffixes=("th.example.net",))
    return table(spark, sf_dir, "pages").select("page_id", flag.alias("open_source"))


@query(
    "repository_item",
    rf"""
    SELECT page_id,
      regexp_matches({sql_part('url', 3)} || '?' || {sql_part('url', 4)}, '/(en|fr)/\d+|[?&]page=\d+') AS is_item
    FROM pages""",
)
def repository_item(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.is_repository_item("url", ITEMS).alias("is_item"))


@query(
    "looks_promising",
    rf"""
    WITH p AS (
      SELECT page_id, url || CASE page_id % 7 WHEN 0 THEN '.pdf' WHEN 1 THEN '&getPDF=1' ELSE '' END AS u FROM pages),
    h AS (SELECT page_id, u, {sql_domain('u')} AS host, lower({sql_part('u', 3)}) AS path,
                 {sql_part('u', 3)} || '?' || {sql_part('u', 4)} AS target FROM p)
    SELECT page_id,
      regexp_matches(u, '(?i)^https?://') AND host <> ''
      AND NOT (contains(host, 'cheap-pills') OR contains(host, 'casino'))
      AND (ends_with(path, '.pdf') OR contains(path, '/pdf') OR contains(lower(u), 'getpdf')
           OR (regexp_matches(host, '(^|\.)example\.org$')
               AND regexp_matches(target, '/(en|fr)/\d+|[?&]page=\d+'))) AS promising
    FROM h""",
)
def looks_promising(spark, sf_dir):
    tail = F.when(F.col("page_id") % 7 == 0, ".pdf").when(F.col("page_id") % 7 == 1, "&getPDF=1").otherwise("")
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("url", tail).alias("u"))
    return pages.select("page_id", U.looks_promising("u", OPEN, BLOCKED, ITEMS).alias("promising"))


@query(
    "content_acceptable",
    rf"""
    WITH p AS (
      SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/file.PDF' ELSE '' END AS u,
             CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'Text/HTML; charset=utf-8'
                              WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN '' ELSE 'image/png' END AS ctype,
             page_id % 3 = 0 AS allow_html
      FROM pages),
    h AS (SELECT *, lower(trim(split_part(ctype, ';', 1))) AS kind,
                 (ends_with(lower({sql_part('u', 3)}), '.pdf') OR contains(lower({sql_part('u', 3)}), '/pdf')
                  OR contains(lower(u), 'getpdf')) AS pdf,
                 regexp_matches({sql_domain('u')}, '(^|\.)example\.org$')
                   AND regexp_matches({sql_part('u', 3)} || '?' || {sql_part('u', 4)}, '/(en|fr)/\d+|[?&]page=\d+') AS item
          FROM p)
    SELECT page_id,
      CASE WHEN kind IN ('application/pdf', 'application/x-pdf') THEN true
           WHEN kind IN ('application/octet-stream', '') THEN pdf
           WHEN kind IN ('text/html', 'application/xhtml+xml') THEN allow_html OR item
           ELSE false END AS acceptable
    FROM h""",
)
def content_acceptable(spark, sf_dir):
    n = F.col("page_id") % 5
    kind = (
        F.when(n == 0, "application/pdf").when(n == 1, "Text/HTML; charset=utf-8")
        .when(n == 2, "application/octet-stream").when(n == 3, "").otherwise("image/png")
    )
    probes = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat("url", F.when(F.col("page_id") % 2 == 0, "/file.PDF").otherwise("")).alias("u"),
        kind.alias("ctype"),
        (F.col("page_id") % 3 == 0).alias("allow_html"),
    )
    ok = U.content_acceptable("u", "ctype", F.col("allow_html"), OPEN, ITEMS)
    return probes.select("page_id", ok.alias("acceptable"))


@query(
    "object_key",
    rf"""
    WITH {SQL_NAMED_PAGES},
    s AS (SELECT page_id, url, rtrim(left(regexp_replace(
            regexp_replace(lower(regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'),
            '^-+|-+$', '', 'g'), 80), '-') AS slug FROM np)
    SELECT page_id, 'pdfs/' || CASE WHEN slug = '' THEN 'document' ELSE slug END || '-'
           || left(sha1({sql_url_key('url')}), 10) || '.pdf' AS object_key
    FROM s""",
)
def object_key(spark, sf_dir):
    return named_pages(spark, sf_dir).select("page_id", U.object_key("title", "url").alias("object_key"))


@query(
    "repo_ids",
    rf"""
    WITH {SQL_NAMED_PAGES}
    SELECT page_id,
      CASE WHEN page_id % 4 IN (0, 1) THEN lower(family) || '_' || page_id ELSE '' END AS archive_id,
      CASE page_id % 4 WHEN 2 THEN 'EJ' || (100000 + page_id) WHEN 3 THEN 'ED' || (200000 + page_id) ELSE '' END AS eric_id
    FROM np""",
)
def repo_ids(spark, sf_dir):
    n = F.col("page_id") % 4
    item = F.concat_ws("_", F.lower("family"), "page_id")
    address = (
        F.when(n == 0, F.concat(F.lit("https://archive.org/details/"), item, F.lit("/page/n3?q=1")))
        .when(n == 1, F.concat(F.lit("https://archive.org/view_archive.php?zip=1&archive=/5/items/"), item, F.lit("/x.zip")))
        .when(n == 2, F.concat(F.lit("https://eric.ed.gov/?q=x&id=ej"), F.col("page_id") + 100000))
        .otherwise(F.concat(F.lit("https://files.example.org/ERIC_ED"), F.col("page_id") + 200000, F.lit(".pdf")))
    )
    pages = named_pages(spark, sf_dir).select("page_id", address.alias("u"))
    return pages.select("page_id", U.archive_id("u").alias("archive_id"), U.eric_id("u").alias("eric_id"))


@query(
    "doi_extract",
    """
    SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE '10.' || (1000 + doc_id) || '/' || source || '.x' END AS doi
    FROM documents""",
)
def doi_extract(spark, sf_dir):
    n = F.col("doc_id") % 4
    doi = F.concat(F.lit("10."), F.col("doc_id") + 1000, F.lit("/"), "source", F.lit(".x"))
    tail = (
        F.when(n == 0, F.concat(F.lit(" see https://doi.org/"), doi, F.lit(".pdf), and")))
        .when(n == 1, F.concat(F.lit(' "'), doi, F.lit('"')))
        .when(n == 2, F.concat(F.lit("\n"), doi, F.lit(".")))
        .otherwise(" 10.12/too-short")
    )
    return table(spark, sf_dir, "documents").select("doc_id", U.extract_doi(F.concat("text", tail)).alias("doi"))


@query(
    "safe_filename",
    rf"""
    WITH {SQL_NAMED_PAGES},
    raw AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '../..' || chr(92) || 'up/' || title || '.TXT'
                                 WHEN 1 THEN '...' || family || '.tar.GZ' WHEN 2 THEN '' ELSE title || chr(7) || '.p-f' END AS f FROM np),
    last AS (SELECT page_id, string_split(replace(f, chr(92), '/'), '/')[-1] AS f FROM raw),
    tidy AS (SELECT page_id, ltrim(trim(regexp_replace(f, '[\x00-\x1f\x7f]', '', 'g')), '.') AS f FROM last),
    done AS (SELECT page_id, left(CASE WHEN f = '' THEN 'upload' ELSE f END, 255) AS filename FROM tidy)
    SELECT page_id, filename, regexp_extract(lower(filename), '^.+(\.[a-z0-9]{{1,12}})$', 1) AS suffix FROM done""",
)
def safe_filename(spark, sf_dir):
    n = F.col("page_id") % 4
    raw = (
        F.when(n == 0, F.concat(F.lit("../..\\up/"), "title", F.lit(".TXT")))
        .when(n == 1, F.concat(F.lit("..."), "family", F.lit(".tar.GZ")))
        .when(n == 2, "")
        .otherwise(F.concat("title", F.lit("\x07.p-f")))
    )
    named = named_pages(spark, sf_dir).select("page_id", U.safe_filename(raw).alias("filename"))
    return named.withColumn("suffix", U.storage_suffix("filename"))


@query(
    "request_identity",
    """
    SELECT event_id, CASE event_type
        WHEN 'purchase' THEN 'user:' || user_id
        WHEN 'click' THEN 'ip:10.0.0.' || (user_id % 250)
        WHEN 'error' THEN 'ip:192.168.1.' || (user_id % 250)
        ELSE 'ip:anonymous' END AS identity
    FROM events""",
)
def request_identity(spark, sf_dir):
    kind, host = F.col("event_type"), (F.col("user_id") % 250).cast("string")
    requests = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "purchase", F.col("user_id")).alias("user_id"),
        F.when(kind == "click", F.concat(F.lit("1.1.1.1 , 10.0.0."), host, F.lit(" "))).alias("forwarded"),
        F.when(kind == "error", F.concat(F.lit("192.168.1."), host)).alias("peer"),
    )
    who = U.request_identity(F.col("user_id"), F.col("forwarded"), F.col("peer"))
    return requests.select("event_id", who.alias("identity"))


# --- page source ---------------------------------------------------------------

def rich_pages(spark, sf_dir):
    """Pages with the scholarly tags the sample lacks, built from their own data."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    family, given, n = F.col("family"), F.col("given"), F.col("page_id")
    head = text(
        '<meta content="', given, " ", family, '" property="citation_author">',
        '<meta name="citation_author" content="', family, ", ", given, '">',
        "<meta name='citation_author' content='", family, ", Otto'>",
        F.when(n % 3 == 0, text('<meta name="citation_title" content=" ', F.col("title"), ' (full) ">')).otherwise(""),
        F.when(n % 3 == 1, text('<meta name="citation_pdf_url" content="/files/', n.cast("string"), '.pdf">')).otherwise(""),
        '<link rel="alternate" type="application/pdf" href="https://files.example.org/', n.cast("string"), '.pdf">',
        "</head>",
    )
    body = text(
        '<a class="galley" href="/index/article/view/', n.cast("string"), '/7">View</a>',
        '<a href="guide.PDF?x=1&amp;y=2">Guide</a><a href="/get/download?id=1"><b>PDF</b> version</a>',
    )
    html = F.concat(F.replace("html", F.lit("</head>"), head), body)
    return named_pages(spark, sf_dir).withColumn("html", html)


_RICH = rf"""
 WITH {SQL_NAMED_PAGES},
 rich AS (SELECT page_id, url, lang, title, family, given,
   replace(html, '</head>',
     '<meta content="' || given || ' ' || family || '" property="citation_author">'
     || '<meta name="citation_author" content="' || family || ', ' || given || '">'
     || '<meta name=''citation_author'' content=''' || family || ', Otto''>'
     || CASE WHEN page_id % 3 = 0 THEN '<meta name="citation_title" content=" ' || title || ' (full) ">' ELSE '' END
     || CASE WHEN page_id % 3 = 1 THEN '<meta name="citation_pdf_url" content="/files/' || page_id || '.pdf">' ELSE '' END
     || '<link rel="alternate" type="application/pdf" href="https://files.example.org/' || page_id || '.pdf">'
     || '</head>')
     || '<a class="galley" href="/index/article/view/' || page_id || '/7">View</a>'
     || '<a href="guide.PDF?x=1&amp;y=2">Guide</a><a href="/get/download?id=1"><b>PDF</b> version</a>' AS html
   FROM np)
"""


@query(
    "html_title",
    rf"""{_RICH}
    SELECT page_id, coalesce(
      nullif(trim(regexp_extract(html, '(?i)<meta[^>]+name=["'']citation_title["''][^>]+content=["'']([^"'']+)["'']', 1)), ''),
      regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g')) AS title
    FROM rich""",
)
def html_title(spark, sf_dir):
    return rich_pages(spark, sf_dir).select("page_id", H.html_title("html").alias("title"))


@query(
    "meta_values",
    f"""{_RICH}
    SELECT page_id, family || ', ' || given || '|' || family || ', Otto|' || given || ' ' || family AS authors FROM rich""",
)
def meta_values(spark, sf_dir):
    values = H.meta_values("html", "citation_author")
    return rich_pages(spark, sf_dir).select("page_id", F.array_join(values, "|").alias("authors"))


@query(
    "pdf_candidates",
    rf"""{_RICH},
    root AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS root,
                    regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '[^/]*$', '') AS folder FROM rich),
    c AS (
      SELECT page_id, 1 AS o, root || '/files/' || page_id || '.pdf' AS link, true AS trusted FROM root WHERE page_id % 3 = 1
      UNION ALL SELECT page_id, 2, 'https://files.example.org/' || page_id || '.pdf', true FROM root
      UNION ALL SELECT page_id, 3, root || '/index/article/download/' || page_id || '/7', true FROM root
      UNION ALL SELECT page_id, 4, root || folder || 'guide.PDF?x=1&y=2', false FROM root
      UNION ALL SELECT page_id, 5, root || '/get/download?id=1', false FROM root)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY o) AS INTEGER) AS rank, link, trusted FROM c""",
)
def pdf_candidates(spark, sf_dir):
    return link_candidates(rich_pages(spark, sf_dir), H.pdf_links("html")).withColumn("rank", F.col("rank").cast("int"))


@query(
    "link_candidates",
    r"""
    WITH a AS (
      SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS root,
             unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"''#]+)["''][^>]*>.*?</a>', 1)) AS href,
             generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"''#]+)["''][^>]*>.*?</a>', 1), 1) AS pos
      FROM pages),
    r AS (SELECT page_id, CASE WHEN starts_with(href, '/') THEN root || replace(trim(href), '&amp;', '&') ELSE trim(href) END AS link, pos FROM a),
    d AS (SELECT page_id, link, min(pos) AS pos FROM r WHERE regexp_matches(link, '^https?://') GROUP BY page_id, link),
    k AS (SELECT page_id, link, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) AS INTEGER) AS rank FROM d)
    SELECT page_id, rank, link, false AS trusted FROM k WHERE rank <= 6""",
)
def all_link_candidates(spark, sf_dir):
    links = link_candidates(table(spark, sf_dir, "pages"), H.all_links("html"))
    return links.withColumn("rank", F.col("rank").cast("int"))


@query(
    "html_authors",
    f"""{_RICH}
    SELECT page_id, 'html:citation_author' AS method, given || ' ' || family || '|Otto ' || family AS authors FROM rich""",
)
def html_authors(spark, sf_dir):
    found = rich_pages(spark, sf_dir).select("page_id", H.html_authors("html").alias("a"))
    return found.select("page_id", "a.method", F.array_join("a.authors", "|").alias("authors"))


@query(
    "jsonld_authors",
    f"""
    WITH {SQL_NAMED_PAGES}
    SELECT page_id, CASE WHEN page_id % 6 IN (0, 1, 3) THEN 'html:json-ld' END AS method,
           CASE WHEN page_id % 6 = 1 THEN given || ' ' || family || '|Otto ' || family WHEN page_id % 6 IN (0, 3) THEN given || ' ' || family END AS authors FROM np""",
)
def jsonld_authors(spark, sf_dir):
    """Pages that name their authors in JSON-LD alone: an object, a list, plain text (which doesn't count), behind a broken block, empty, not at all."""
    name, otto = F.concat_ws(" ", "given", "family"), F.concat(F.lit("Otto "), "family")
    block = lambda *parts: F.concat(F.lit('<script type="application/ld+json">'), *[F.lit(x) if isinstance(x, str) else x for x in parts], F.lit("</script>"))
    kinds = [
        block('{"@type": "Article", "author": {"name": "', name, '"}}'),
        block('[{"@type": "Organization"}, {"author": [{"name": "', name, '"}, {"name": "', otto, '"}, {"name": "', name, '"}]}]'),
        block('{"author": "', name, '"}'),
        F.concat(block('{"author": '), block('{"author": [{"name": "', name, '"}]}')),
        block('{"author": {"name": ""}}'),
        block('{"headline": "', name, '"}'),
    ]
    pages = named_pages(spark, sf_dir)
    html = F.concat(F.lit("<html><head>"), F.get(F.array(*kinds), F.pmod("page_id", F.lit(len(kinds))).cast("int")), F.lit("</head>"), F.coalesce("html", F.lit("")))
    found = pages.select("page_id", H.html_authors(html).alias("a"))
    return found.select("page_id", "a.method", F.array_join("a.authors", "|").alias("authors"))


@query(
    "page_outcome",
    r"""
    WITH l AS (SELECT page_id, html, [200, 404, 403, 202, 503, 200, 301, 200, 200, 429, 200][(page_id % 11 + 1)::INTEGER] AS status,
        ['application/pdf', 'text/html', 'image/png', 'application/pdf; x'][(page_id % 4 + 1)::INTEGER] AS ctype,
        page_id % 3 = 0 AS is_pdf, (page_id % 5) * 50000000 AS bytes, page_id % 6 = 1 AS walled FROM pages)
    SELECT page_id, CASE
      WHEN status IN (404, 410) THEN 'failed: HTTP ' || status || ' (no longer there)'
      WHEN status IN (401, 403) THEN 'failed: HTTP ' || status || ' (not allowed)'
      WHEN status = 202 THEN 'retry: HTTP 202 (visitor check)'
      WHEN status IN (408, 429) OR status >= 500 THEN 'retry: HTTP ' || status
      WHEN status <> 200 THEN 'failed: HTTP ' || status
      WHEN is_pdf AND bytes > 157286400 THEN 'failed: file above the limit (' || (bytes // 1048576) || ' MB)'
      WHEN is_pdf THEN 'ok'
      WHEN contains(ctype, 'pdf') THEN 'failed: announced as PDF, other content'
      WHEN NOT regexp_matches(ctype, 'html|xml|text') THEN 'failed: other type (' || ctype || ')'
      WHEN walled AND length(html) + 21 < 50000 THEN 'failed: visitor check page'
      ELSE 'html' END AS outcome
    FROM l""",
)
def page_outcome(spark, sf_dir):
    n = F.col("page_id")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    log = table(spark, sf_dir, "pages").select(
        "page_id",
        pick([200, 404, 403, 202, 503, 200, 301, 200, 200, 429, 200], n % 11).alias("status"),
        pick(["application/pdf", "text/html", "image/png", "application/pdf; x"], n % 4).alias("ctype"),
        F.when(n % 3 == 0, F.concat(F.lit("\n\n%PDF-1.7 "), "html")).otherwise(F.col("html")).cast("binary").alias("head"),
        ((n % 5) * 50_000_000).alias("bytes"),
        F.concat(F.when(n % 6 == 1, "<title>Just a moment ").otherwise("<title>"), "html").alias("html"),
    )
    outcome = H.fetch_outcome(F.col("status"), F.col("ctype"), F.col("head"), F.col("bytes"), F.col("html"))
    return log.select("page_id", outcome.alias("outcome"))


@query(
    "clean_title",
    rf"""
    WITH {SQL_NAMED_PAGES},
    r AS (SELECT page_id, url, trim(regexp_replace(CASE page_id % 5 WHEN 0 THEN '[PDF] ' || title || ' : Internet Archive'
          WHEN 1 THEN title || ' | ' || family || ' – Google Books' WHEN 2 THEN title || ' ...' WHEN 3 THEN 'ab' ELSE title END,
          '\s+', ' ', 'g')) AS t FROM np),
    a AS (SELECT page_id, url, regexp_replace(trim(regexp_replace(t, '(?i)^\[?\s*PDF\s*\]?\s*', '')), '^[ \-|–—·:]+|[ \-|–—·:]+$', '', 'g') AS t FROM r),
    b AS (SELECT page_id, url, trim(regexp_replace(t, '(?i)(\s*[:|–—]\s*({'|'.join(x.replace('.', chr(92) + '.') for x in rules.TITLE_BOILERPLATE)})\s*){{1,4}}$', '')) AS t FROM a),
    c AS (SELECT page_id, url, CASE WHEN length(t) > 60 THEN regexp_replace(t, '\s*[|–—]\s*[^|–—]{{0,40}}$', '') ELSE t END AS t FROM b),
    d AS (SELECT page_id, url, trim(regexp_replace(trim(regexp_replace(t, '\s*[.…]{{2,}}\s*$', '')), '^[:|–—]+|[:|–—]+$', '', 'g')) AS t FROM c),
    s AS (SELECT page_id, t, {sql_domain('url')} AS host,
            trim(regexp_replace(regexp_replace(regexp_extract({sql_part('url', 3)}, '([^/]+)/*$', 1), '^(.+)\.[^.]+$', '\1'), '[_\-+.]+', ' ', 'g')) AS stem FROM d)
    SELECT page_id, left(CASE WHEN length(t) >= 5 THEN t WHEN stem <> '' THEN stem ELSE host END, 500) AS title FROM s""",
)
def clean_titles(spark, sf_dir):
    n = F.col("page_id") % 5
    raw = (
        F.when(n == 0, F.concat(F.lit("[PDF] "), "title", F.lit(" : Internet Archive")))
        .when(n == 1, F.concat("title", F.lit(" | "), "family", F.lit(" – Google Books")))
        .when(n == 2, F.concat("title", F.lit(" ...")))
        .when(n == 3, F.lit("ab"))
        .otherwise(F.col("title"))
    )
    return named_pages(spark, sf_dir).select("page_id", clean_title(raw, "url").alias("title"))
