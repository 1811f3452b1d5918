"""URL columns: canonical form, host rules, shape rules, identifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions.arrow import ascii_only
from corpusflow.functions.basic import alternation, col, nullif_blank, percent_decode, strip

# The generic URI grammar; ``parse_url`` is not used since it gives NULL for
# hosts it dislikes.
_URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_SCHEME, _AUTHORITY, _PATH, _QUERY = 1, 2, 3, 4


def _part(url: Column | str, group: int) -> Column:
    return F.regexp_extract(col(url), _URI, group)


def url_path(url: Column | str) -> Column:
    return _part(url, _PATH)


def url_query(url: Column | str) -> Column:
    return _part(url, _QUERY)


def is_http(url: Column | str) -> Column:
    return F.coalesce(col(url).rlike(r"(?i)^https?://"), F.lit(False))


def http_or_null(url: Column | str) -> Column:
    url = strip(col(url))
    return F.when(is_http(url), url)


def normalise_url(url: Column | str, tracking: Sequence[str] = rules.TRACKING_PREFIXES) -> Column:
    """One key per document: variants of the same address collapse."""
    raw = strip(col(url))
    scheme, authority, path = _part(raw, _SCHEME), _part(raw, _AUTHORITY), _part(raw, _PATH)
    host = F.regexp_replace(F.lower(authority), r"^www\.", "")
    host = F.regexp_replace(F.regexp_replace(host, r":80$", ""), r":443$", "")
    noise = rf"(?i)^(?:{alternation(tracking)})"
    query = F.array_join(
        F.filter(F.split(_part(raw, _QUERY), "&"), lambda p: (p != "") & ~p.rlike(noise)), "&"
    )
    path = F.regexp_replace(path, r"(?s)(?<=.)/$", "")
    canonical = F.concat(
        F.lower(scheme), F.lit("://"), host, path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )
    return F.when((scheme != "") & (authority != ""), canonical).otherwise(raw)


def source_domain(url: Column | str) -> Column:
    """Host without port and ``www.``; subdomains are kept."""
    host = F.regexp_extract(F.lower(_part(url, _AUTHORITY)), r"^([^:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def host_matches(host: Column, domains: Sequence[str]) -> Column:
    """Host equals a listed domain or lies below one."""
    if not domains:
        return F.lit(False)
    return host.rlike(rf"(?:^|\.)(?:{alternation(domains)})$")


def is_open_access(
    url: Column | str,
    open_domains: Sequence[str] = rules.OPEN_ACCESS_DOMAINS,
    closed_domains: Sequence[str] = rules.CLOSED_ACCESS_DOMAINS,
    open_suffixes: Sequence[str] = rules.OPEN_TLD_SUFFIXES,
) -> Column:
    host = source_domain(url)
    return (
        F.when(host == "", False)
        .when(host_matches(host, closed_domains), False)
        .when(host_matches(host, open_domains), True)
        .otherwise(host.rlike(rf"(?:{alternation(open_suffixes)})$"))
    )


def is_repository_item(
    url: Column | str, patterns: Sequence[str] = rules.REPOSITORY_ITEM_PATTERNS
) -> Column:
    target = F.concat(url_path(url), F.lit("?"), url_query(url))
    return target.rlike("|".join(f"(?:{p})" for p in patterns))


def is_pdf_shaped(url: Column | str, with_fulltext: bool = False) -> Column:
    path = F.lower(url_path(url))
    shape = r"\.pdf$|/pdf" + ("|fulltext" if with_fulltext else "")
    return path.rlike(shape) | F.lower(col(url)).contains("getpdf")


def is_blocked_host(host: Column, fragments: Sequence[str] = rules.BLOCKED_HOST_FRAGMENTS) -> Column:
    return host.rlike(alternation(fragments)) if fragments else F.lit(False)


def looks_promising(
    url: Column | str,
    open_domains: Sequence[str] = rules.OPEN_ACCESS_DOMAINS,
    blocked: Sequence[str] = rules.BLOCKED_HOST_FRAGMENTS,
    item_patterns: Sequence[str] = rules.REPOSITORY_ITEM_PATTERNS,
) -> Column:
    """Worth a probe: PDF-shaped, or a named item on a known repository."""
    host = source_domain(url)
    return (
        is_http(url)
        & (host != "")
        & ~is_blocked_host(host, blocked)
        & (is_pdf_shaped(url) | (host_matches(host, open_domains) & is_repository_item(url, item_patterns)))
    )


def content_acceptable(
    url: Column | str,
    content_type: Column | str,
    allow_html: Column | bool = False,
    open_domains: Sequence[str] = rules.OPEN_ACCESS_DOMAINS,
    item_patterns: Sequence[str] = rules.REPOSITORY_ITEM_PATTERNS,
) -> Column:
    """Does a probe result (final address, content type) hold a document?"""
    kind = F.lower(strip(F.substring_index(F.coalesce(col(content_type), F.lit("")), ";", 1)))
    allow = F.lit(allow_html) if isinstance(allow_html, bool) else allow_html
    pdf = is_pdf_shaped(url)
    item = host_matches(source_domain(url), open_domains) & is_repository_item(url, item_patterns)
    return (
        F.when(kind.isin("application/pdf", "application/x-pdf"), True)
        .when(kind.isin("application/octet-stream", ""), pdf)
        .when(kind.isin("text/html", "application/xhtml+xml"), allow | item)
        .otherwise(False)
    )


def slugify(text: Column | str, limit: int = 80) -> Column:
    slug = F.regexp_replace(F.lower(ascii_only(col(text))), r"[^a-z0-9]+", "-")
    slug = F.regexp_replace(slug, r"^-+|-+$", "")
    slug = F.regexp_replace(F.left(slug, F.lit(limit)), r"-+$", "")
    return F.coalesce(nullif_blank(slug), F.lit("document"))


def object_key(title: Column | str, url: Column | str, prefix: str = "pdfs/") -> Column:
    digest = F.left(F.sha1(normalise_url(url).cast("binary")), F.lit(10))
    return F.concat(F.lit(prefix), slugify(title), F.lit("-"), digest, F.lit(".pdf"))


def archive_id(url: Column | str) -> Column:
    """Item name in an archive.org address, '' when there is none."""
    path = percent_decode(url_path(url))
    viewer = F.regexp_extract(url_query(url), r"(?:^|&)archive=([^&]*)", 1)
    path = F.when(path.contains("view_archive.php"), percent_decode(F.replace(viewer, F.lit("+"), F.lit(" ")))).otherwise(path)
    return F.regexp_extract(path, r"/(?:details|stream|download|embed|items)/([^/?#]+)", 1)


def eric_id(url: Column | str) -> Column:
    """ERIC accession number from the site, its query string or a mirror."""
    host = F.lower(_part(url, _AUTHORITY))
    in_path = F.regexp_extract(url_path(url), r"(?i)\b(E[DJ]\d{5,7})\b", 1)
    in_query = F.regexp_extract(url_query(url), r"(?i)(?:^|&)id=(E[DJ]\d+)(?:&|$)", 1)
    mirror = F.regexp_extract(col(url), r"(?i)ERIC_(E[DJ]\d{5,7})", 1)
    on_site = F.when(in_path != "", in_path).otherwise(in_query)
    return F.upper(F.when(host.contains("eric.ed.gov"), on_site).otherwise(mirror))


def extract_doi(text: Column | str) -> Column:
    """First DOI in a text, without trailing punctuation or file extension."""
    found = F.regexp_extract(F.coalesce(col(text), F.lit("")), rules.DOI, 1)
    return F.regexp_replace(found, rules.DOI_TAIL, "")


def safe_filename(raw: Column | str, limit: int = 255) -> Column:
    name = F.replace(F.coalesce(col(raw), F.lit("")), F.lit("\\"), F.lit("/"))
    # the last path component; "." components and trailing slashes do not count
    name = F.regexp_replace(name, r"(?:/|(?<=/)\.(?=/|$))+$", "")
    name = F.element_at(F.split(name, "/"), -1)
    name = F.when(name == ".", "").otherwise(name)
    name = strip(F.regexp_replace(name, r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", ""))
    name = F.regexp_replace(name, r"^\.+", "")
    return F.left(F.coalesce(nullif_blank(name), F.lit("upload")), F.lit(limit))


def storage_suffix(filename: Column | str) -> Column:
    """Lower-case extension when it is harmless, else ''."""
    return F.regexp_extract(F.lower(col(filename)), r"^.+(\.[a-z0-9]{1,12})$", 1)


def request_identity(user_id: Column, forwarded: Column, peer: Column) -> Column:
    """Rate-limit key: the user when known, else the nearest trusted address."""
    hop = strip(F.element_at(F.split(forwarded, ","), -1))
    address = F.coalesce(F.when(forwarded != "", hop), peer, F.lit("anonymous"))
    return F.coalesce(F.concat(F.lit("user:"), user_id.cast("string")), F.concat(F.lit("ip:"), address))


def resolve_href(base: Column, href: Column) -> Column:
    """Resolve a link against its page: absolute, ``//``, ``/``, ``?`` or relative."""
    scheme = _part(base, _SCHEME)
    root = F.concat(scheme, F.lit("://"), _part(base, _AUTHORITY))
    path = _part(base, _PATH)
    folder = F.regexp_replace(path, r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    target = (
        F.when(href.rlike(r"^/"), href)
        .when(href.rlike(r"^\?"), F.concat(path, href))
        .otherwise(F.concat(folder, href))
    )
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.rlike(r"^//"), F.concat(scheme, F.lit(":"), href))
        .when(href == "", base)
        .otherwise(F.concat(root, _squash_dots(target)))
    )


def _squash_dots(target: Column) -> Column:
    """Remove ``.`` and ``..`` segments from the path of a rooted target."""
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    parts = F.split(path, "/")
    folder_end = F.element_at(parts, -1).isin(".", "..")
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc)
        .when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(1), F.size(acc) - 1)))
        .otherwise(F.concat(acc, F.array(p))),
    )
    clean = F.concat(F.array_join(walked, "/"), F.when(folder_end, "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(clean, tail)).otherwise(target)
