"""Landed catalogue answers -> one harvest record shape.

A landed page is a row ``(source, concept, payload)`` holding one answer of one
catalogue. Each mapper parses the payload with an explicit schema, explodes its
records and projects them to ``(source, concept, url, title, authors,
needs_check)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions.arrow import fold, ratcliff_ratio
from corpusflow.functions.basic import SPACE, collapse, first_match, nullif_blank, percent_encode, strip
from corpusflow.functions.names import (
    clean_name, is_plausible_creator, split_name_list, unique_names,
)
from corpusflow.functions.text import is_machine_written, latin_words, phrase_in_text
from corpusflow.functions.titles import unwrap_full_text_title
from corpusflow.functions.urls import http_or_null

#: Catalogues that rank by relevance, so their records are checked again.
LOOSE_SOURCES = ("openalex", "semanticscholar", "crossref")


def _text(c: Column) -> Column:
    """A field that is absent, NULL or blank is NULL."""
    return nullif_blank(strip(c))


def scalar_or_list(raw: Column) -> Column:
    """A field the catalogue sends either as a string or as a list of strings.

    Read as a string, the list form keeps its JSON text.
    """
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))


def _record(url: Column, title: Column, authors: Column) -> Column:
    return F.struct(url.alias("url"), title.alias("title"), authors.alias("authors"))


def openalex(payload: Column) -> Column:
    works = F.from_json(
        payload,
        "results array<struct<display_name:string,"
        "best_oa_location:struct<pdf_url:string,landing_page_url:string>,"
        "authorships:array<struct<author:struct<display_name:string>>>>>",
    )["results"]
    return F.transform(
        works,
        lambda w: _record(
            F.coalesce(_text(w["best_oa_location"]["pdf_url"]), w["best_oa_location"]["landing_page_url"]),
            w["display_name"],
            w["authorships"]["author"]["display_name"],
        ),
    )


def archive_org(payload: Column) -> Column:
    docs = F.from_json(
        payload, "response struct<docs:array<struct<identifier:string,creator:string,title:string>>>"
    )["response"]["docs"]
    return F.transform(
        docs,
        lambda d: _record(
            F.concat(F.lit("https://archive.org/details/"), percent_encode(_text(d["identifier"]))),
            d["title"],
            scalar_or_list(d["creator"]),
        ),
    )


def zenodo(payload: Column) -> Column:
    hits = F.from_json(
        payload,
        "hits struct<hits:array<struct<metadata:struct<title:string,creators:array<struct<name:string>>>,"
        "files:array<struct<key:string,links:struct<self:string>>>,links:struct<self_html:string>>>>",
    )["hits"]["hits"]

    def one(h: Column) -> Column:
        pdf = first_match(h["files"], lambda f: F.lower(f["key"]).endswith(".pdf"))
        file = F.coalesce(pdf, F.try_element_at(h["files"], F.lit(1)))
        url = F.coalesce(_text(file["links"]["self"]), h["links"]["self_html"])
        return _record(url, h["metadata"]["title"], h["metadata"]["creators"]["name"])

    return F.transform(hits, one)


def doaj(payload: Column) -> Column:
    items = F.from_json(
        payload,
        "results array<struct<bibjson:struct<title:string,author:array<struct<name:string>>,"
        "link:array<struct<type:string,url:string>>>>>",
    )["results"]["bibjson"]

    def one(b: Column) -> Column:
        link = F.coalesce(
            first_match(b["link"], lambda x: F.lower(x["type"]) == "fulltext"), F.try_element_at(b["link"], F.lit(1))
        )
        return _record(link["url"], b["title"], b["author"]["name"])

    return F.transform(items, one)


def hal(payload: Column) -> Column:
    docs = F.from_json(
        payload,
        "response struct<docs:array<struct<title_s:string,fileMain_s:string,uri_s:string,authFullName_s:string>>>",
    )["response"]["docs"]
    return F.transform(
        docs,
        lambda d: _record(
            F.coalesce(_text(d["fileMain_s"]), d["uri_s"]),
            F.try_element_at(scalar_or_list(d["title_s"]), F.lit(1)),
            scalar_or_list(d["authFullName_s"]),
        ),
    )


def semantic_scholar(payload: Column) -> Column:
    papers = F.from_json(
        payload, "data array<struct<title:string,openAccessPdf:struct<url:string>,authors:array<struct<name:string>>>>"
    )["data"]
    return F.transform(papers, lambda p: _record(p["openAccessPdf"]["url"], p["title"], p["authors"]["name"]))


def crossref(payload: Column) -> Column:
    items = F.from_json(
        payload,
        "message struct<items:array<struct<title:array<string>,author:array<struct<given:string,family:string>>,"
        "link:array<struct<URL:string,`content-type`:string>>>>>",
    )["message"]["items"]

    def one(i: Column) -> Column:
        link = first_match(i["link"], lambda x: F.lower(x["content-type"]).contains("pdf"))
        names = F.transform(i["author"], lambda a: F.concat_ws(" ", _text(a["given"]), _text(a["family"])))
        return _record(link["URL"], F.try_element_at(i["title"], F.lit(1)), names)

    return F.transform(items, one)


def core(payload: Column) -> Column:
    works = F.from_json(
        payload,
        "results array<struct<title:string,downloadUrl:string,links:array<struct<type:string,url:string>>,"
        "authors:array<struct<name:string>>>>",
    )["results"]

    def one(w: Column) -> Column:
        offered = F.filter(w["links"], lambda x: F.lower(x["type"]).isin("download", "reader"))["url"]
        urls = F.concat(F.array(w["downloadUrl"]), F.coalesce(offered, F.array().cast("array<string>")))
        return _record(first_match(urls, lambda u: http_or_null(u).isNotNull()), w["title"], w["authors"]["name"])

    return F.transform(works, one)


MAPPERS: dict[str, Callable[[Column], Column]] = {
    "openalex": openalex,
    "archive.org": archive_org,
    "zenodo": zenodo,
    "doaj": doaj,
    "hal": hal,
    "semanticscholar": semantic_scholar,
    "crossref": crossref,
    "core": core,
}


def harvest(pages: DataFrame, sources: Iterable[str] = tuple(MAPPERS)) -> DataFrame:
    """Landed pages of keyword catalogues in one record shape.

    One pass over the landing table: a page is parsed with its own source's
    schema only. Records without an http address are dropped, titles tidied,
    blank authors removed.
    """
    sources = tuple(sources)
    mapped = None
    for name in sources:
        parsed = MAPPERS[name](F.col("payload"))
        here = F.col("source") == name
        mapped = F.when(here, parsed) if mapped is None else mapped.when(here, parsed)
    records = pages.where(F.col("source").isin(*sources)).select("source", "concept", F.explode(mapped).alias("r"))
    names = F.filter(F.transform("r.authors", strip), lambda a: a != "")
    return records.select(
        "source",
        "concept",
        http_or_null("r.url").alias("url"),
        collapse("r.title").alias("title"),
        F.coalesce(names, F.array().cast("array<string>")).alias("authors"),
        F.col("source").isin(*LOOSE_SOURCES).alias("needs_check"),
    ).where("url IS NOT NULL")


_OAI_SCHEMA = (
    "ListRecords struct<record:array<struct<"
    "header:struct<_status:string,identifier:string>,"
    "metadata:struct<dc:struct<"
    "title:array<string>,creator:array<string>,subject:array<string>,"
    "description:array<string>,identifier:array<string>>>>>,"
    "resumptionToken:string>, error struct<_code:string,_VALUE:string>"
)
#: Elements count by their names, not by the prefix an answer happens to give them.
_OAI_OPTIONS = {"rowTag": "OAI-PMH", "mode": "PERMISSIVE", "ignoreNamespace": "true"}


def oai_outcome(pages: DataFrame) -> DataFrame:
    """What each landed answer amounts to: its columns, ``records``, ``token``
    (where the walk goes on) and ``reason``.

    ``reason`` is null for an answer with records, else ``error: <code>``,
    ``unreadable`` or ``no records``.
    """
    read = pages.withColumn("_x", F.from_xml("payload", _OAI_SCHEMA, _OAI_OPTIONS))
    records = F.greatest(F.coalesce(F.size("_x.ListRecords.record"), F.lit(0)), F.lit(0))
    reason = (
        F.when(F.col("_x.error").isNotNull(), F.concat(F.lit("error: "), F.coalesce("_x.error._code", F.lit("unknown"))))
        .when(F.col("_x.ListRecords").isNull(), "unreadable")
        .when(records == 0, "no records")
    )
    token = strip("_x.ListRecords.resumptionToken")
    return read.select(*pages.columns, records.alias("records"), F.when(token != "", token).alias("token"), reason.alias("reason"))


def oai_pmh(pages: DataFrame, label: Callable[[DataFrame, str, str], DataFrame]) -> DataFrame:
    """OAI-PMH answers. A walk has no search term, so ``label(df, text, out)``
    supplies the concept; records no concept matches are dropped."""
    xml = pages.select("source", F.from_xml("payload", _OAI_SCHEMA, _OAI_OPTIONS).alias("x"))
    df = xml.select("source", F.explode("x.ListRecords.record").alias("r")).where(
        "coalesce(r.header._status, '') <> 'deleted' AND r.metadata IS NOT NULL"
    )
    dc = F.col("r.metadata.dc")

    def values(tag: str) -> Column:
        items = F.coalesce(dc[tag], F.array().cast("array<string>"))
        return F.filter(F.transform(items, strip), lambda v: v != "")

    df = df.select(
        "source",
        values("title").alias("titles"),
        values("creator").alias("authors"),
        F.concat_ws(" ", values("title"), values("subject"), F.slice(values("description"), 1, 1)).alias("match_text"),
        first_match(values("identifier"), lambda u: http_or_null(u).isNotNull()).alias("url"),
    ).where("size(titles) > 0 AND url IS NOT NULL")
    return label(df, "match_text", "concept").where("coalesce(concept, '') <> ''").select(
        F.concat(F.lit("oai:"), "source").alias("source"),
        "concept",
        "url",
        F.regexp_replace(F.element_at("titles", 1), rf"[{SPACE}]+", " ").alias("title"),
        "authors",
        F.lit(False).alias("needs_check"),
    )


def strict_filter(records: DataFrame, strict: bool = True) -> DataFrame:
    """Drop machine-written items and, for searched catalogues, records whose
    title does not carry the concept. Walked catalogues were matched already."""
    human = ~is_machine_written(F.col("authors"))
    if not strict:
        walked = F.col("source").startswith("oai:")
        return records.where(~walked | human)
    walked = F.col("source").startswith("oai:")
    return records.where(human & (walked | phrase_in_text(F.col("concept"), F.col("title"))))


# --- attribution answers -----------------------------------------------------

def _creators(raw: Column) -> Column:
    """Clean, plausible, distinct creators of a curated field."""
    return unique_names(F.filter(F.transform(raw, clean_name), is_plausible_creator))


def _crossref_name(a: Column) -> Column:
    named = (F.coalesce(a["given"], F.lit("")) != "") | (F.coalesce(a["family"], F.lit("")) != "")
    return F.when(named, F.concat_ws(" ", a["given"], a["family"])).otherwise(F.coalesce(a["name"], F.lit("")))


def title_evidence(answers: DataFrame, titles: DataFrame, min_ratio: float = rules.TITLE_MATCH_MIN) -> DataFrame:
    """Landed title searches ``(key, kind, payload)`` and ``titles(key, title)`` -> ``(key, method, authors)``.

    ``kind`` is ``crossref:title`` or ``openalex:title``, the payload a list of works. The first work
    counts whose title is near enough (Ratcliff–Obershelp on accent-free words) and which has a
    plausible author. Lengths that rule the ratio out are dropped before it is computed.
    """
    crossref = F.from_json(
        "payload", "message struct<items:array<struct<title:array<string>,author:array<struct<given:string,family:string,name:string>>>>>"
    )["message"]["items"]
    openalex = F.from_json("payload", "results array<struct<display_name:string,authorships:array<struct<author:struct<display_name:string>>>>>")["results"]
    works = F.when(
        F.col("kind") == "crossref:title",
        F.transform(crossref, lambda w: F.struct(F.try_element_at(w["title"], F.lit(1)).alias("title"), F.transform(w["author"], _crossref_name).alias("names"))),
    ).otherwise(
        F.transform(openalex, lambda w: F.struct(w["display_name"].alias("title"), w["authorships"]["author"]["display_name"].alias("names")))
    )
    asked = answers.where(F.col("kind").isin("crossref:title", "openalex:title")).select("key", "kind", F.posexplode(works).alias("place", "work"))
    found = asked.select("key", "kind", "place", F.col("work.title").alias("found"), _creators(F.col("work.names")).alias("authors"))
    found = found.where("size(authors) > 0").join(titles.select("key", F.col("title").alias("asked")), "key")
    found = found.withColumn("asked", unwrap_full_text_title("asked")).withColumn("found", F.coalesce("found", F.lit("")))
    found = found.withColumns({"asked": latin_words(fold("asked")), "found": latin_words(fold("found"))})
    la, lb = F.length("asked"), F.length("found")
    near = found.where((la > 0) & (2 * F.least(la, lb) >= min_ratio * (la + lb)))
    near = near.where(ratcliff_ratio(F.col("asked"), F.col("found")) >= min_ratio)
    return near.groupBy("key", F.col("kind").alias("method")).agg(F.min_by("authors", "place").alias("authors"))


def author_evidence(answers: DataFrame) -> DataFrame:
    """Landed lookups ``(key, kind, payload)`` -> ``(key, method, authors)``.

    ``kind`` is one of ``eric``, ``archive.org``, ``crossref:doi``,
    ``openalex:title`` (one work, compared already); rows that yield no author
    are dropped. Lists of works found by a title are ``title_evidence``'s.
    """
    eric = F.from_json("payload", "response struct<docs:array<struct<author:array<string>>>>")
    archive = F.from_json("payload", "metadata struct<creator:string>")
    doi = F.from_json("payload", "message struct<author:array<struct<given:string,family:string,name:string>>>")
    alex = F.from_json("payload", "authorships array<struct<author:struct<display_name:string>>>")
    listed = F.flatten(F.transform(scalar_or_list(archive["metadata"]["creator"]), split_name_list))
    names = (
        F.when(F.col("kind") == "eric", F.try_element_at(eric["response"]["docs"]["author"], F.lit(1)))
        .when(F.col("kind") == "archive.org", listed)
        .when(F.col("kind") == "crossref:doi", F.transform(doi["message"]["author"], _crossref_name))
        .when(F.col("kind") == "openalex:title", alex["authorships"]["author"]["display_name"])
    )
    return answers.select("key", F.col("kind").alias("method"), _creators(names).alias("authors")).where(
        "size(authors) > 0"
    )
