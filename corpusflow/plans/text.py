"""Text, title and name queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import text as X
from corpusflow.functions.arrow import fold
from corpusflow.functions.names import (
    clean_name, format_authors, is_plausible_creator, is_plausible_person, name_in_text, split_name_list,
    surname_in_text, tidy_extracted_name, unique_names,
)
from corpusflow.operators.matching import concept_label, near_titles, normal_title
from corpusflow.plans.common import (
    SQL_NAMED_PAGES, named_pages, query, spread, sql_sanitize, sql_strip, sql_words, table,
)
from corpusflow.session import materialise
from corpusflow.sources.ledger import validate_rows
from corpusflow.sources.structured import PART_SPEC, validate_json


_DIRTY = (
    "CASE doc_id % 3 WHEN 0 THEN '</retrieved_sources> [INST]' || chr(8203) || text "
    "WHEN 1 THEN text || ' <|im_start|>      x' || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || '<System >' || chr(7) ELSE text END"
)


def dirty_documents(spark, sf_dir):
    n = F.col("doc_id") % 3
    text = (
        F.when(n == 0, F.concat(F.lit("</retrieved_sources> [INST]​"), "text"))
        .when(n == 1, F.concat("text", F.lit(" <|im_start|>      x\n\n\n\n\n<System >\x07")))
        .otherwise(F.col("text"))
    )
    return spread(table(spark, sf_dir, "documents")).withColumn("text", text)


@query(
    "sanitize",
    f"WITH d AS (SELECT doc_id, {_DIRTY} AS t FROM documents) SELECT doc_id, {sql_sanitize('t')} AS clean FROM d",
)
def sanitize(spark, sf_dir):
    return dirty_documents(spark, sf_dir).select("doc_id", X.sanitize("text").alias("clean"))


@query(
    "token_budget",
    f"""
    WITH c AS (SELECT conv_id, turn, text, {sql_sanitize('text')} AS clean, role FROM conversations)
    SELECT conv_id, turn, CAST(greatest(1, length(clean) // 4) AS INTEGER) AS tokens,
      CASE WHEN length(text) < 1 OR length(text) > 4000 THEN 'bad_length' WHEN clean = '' THEN 'empty'
           WHEN greatest(1, length(clean) // 4) > 60 THEN 'over_budget' ELSE 'ok' END AS verdict,
      role IN ('user') AS in_scope
    FROM c""",
)
def token_budget(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("clean", X.sanitize("text"))
    return turns.select(
        "conv_id", "turn", X.estimate_tokens("clean").alias("tokens"),
        X.prompt_verdict("text", budget=60, clean=F.col("clean")).alias("verdict"),
        X.scope_allowed("role", ["user"]).alias("in_scope"),
    )


@query(
    "chunk_chars",
    rf"""
    WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents),
    step AS (
      SELECT doc_id, text, n, 0 AS s, CAST(NULL AS BIGINT) AS e, 0 AS k, false AS done FROM d
      UNION ALL
      SELECT doc_id, text, n, CASE WHEN fin THEN s2 ELSE e2 - 150 END, e2, k + 1, fin FROM (
        SELECT doc_id, text, n, k, s AS s2, n < s + 900 AS fin,
          CASE WHEN n <= s + 900 THEN n
               WHEN regexp_matches(substr(text, s + 900, 1), '\s') <> regexp_matches(substr(text, s + 901, 1), '\s') THEN s + 900
               ELSE s + 900 + length(regexp_extract(substr(text, s + 901), '^(\s+|\S+)')) END AS e2
        FROM step WHERE NOT done)),
    pieces AS (
      SELECT doc_id, k, {sql_strip("substr(text, CAST(CASE WHEN done THEN s ELSE lag_s END AS BIGINT) + 1, CAST(e - CASE WHEN done THEN s ELSE lag_s END AS BIGINT))")} AS chunk
      FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id ORDER BY k) AS lag_s FROM step) WHERE k > 0)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_index,
           CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS digest
    FROM pieces WHERE chunk <> ''""",
)
def chunk_chars(spark, sf_dir):
    chunks = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.posexplode_outer(X.chunk_chars("text")).alias("chunk_index", "chunk")
    ).where("chunk_index IS NOT NULL")
    return chunks.select(
        "doc_id", "chunk_index", F.char_length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("digest")
    )


@query(
    "chunk_tokens",
    r"""
    WITH t AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS tok FROM documents),
    s AS (SELECT doc_id, tok, unnest(range(1, greatest(1, len(tok) - 75) + 1, 425)) AS s FROM t WHERE len(tok) > 0)
    SELECT doc_id, CAST((s - 1) // 425 AS INTEGER) AS chunk_index, CAST(len(tok[s:s + 499]) AS INTEGER) AS n_tokens,
           md5(array_to_string(tok[s:s + 499], ' ')) AS digest
    FROM s""",
)
def chunk_tokens(spark, sf_dir):
    chunks = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", F.posexplode_outer(X.chunk_tokens("text")).alias("chunk_index", "c")
    ).where("chunk_index IS NOT NULL")
    return chunks.select("doc_id", "chunk_index", "c.n_tokens", F.md5(F.col("c.chunk").cast("binary")).alias("digest"))


@query(
    "chunk_counts",
    r"""
    WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents)
    SELECT doc_id, CASE WHEN n = 0 THEN 0 ELSE 1 + greatest(0, CAST(ceil((n - 500) / 425.0) AS BIGINT)) END AS chunks FROM t""",
)
def chunk_counts(spark, sf_dir):
    """Chunks of each document; a document without words has none."""
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(X.chunk_tokens("text")).alias("chunk_index", "c"))
    return chunks.groupBy("doc_id").agg(F.count("chunk_index").alias("chunks"))


@query(
    "session_titles",
    f"""
    WITH p AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT conv_id, left(prompt, 80) AS title, left(prompt, 600) AS preview FROM p""",
)
def session_titles(spark, sf_dir):
    """A session is named by its first prompt."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("prompt"))
    return first.select("conv_id", X.session_title("prompt").alias("title"), X.preview("prompt").alias("preview"))


@query(
    "relevance",
    rf"""
    WITH {SQL_NAMED_PAGES},
    c AS (SELECT page_id, title, url, family || ' history ' || lang || 'xx ' || given AS concept FROM np),
    w AS (SELECT *, regexp_extract_all(lower(concept), '[a-z0-9]{{3,}}') AS words,
                 lower(title || ' ' || regexp_replace(url, '[^a-zA-Z0-9]+', ' ', 'g') || ' ') AS hay FROM c),
    k AS (SELECT *, list_filter(words, lambda x: x NOT IN ('the','and','for','with','from','into','past','questions','history')) AS kept FROM w),
    t AS (SELECT *, CASE WHEN len(kept) > 0 THEN kept ELSE words END AS tokens FROM k)
    SELECT page_id, CASE WHEN len(tokens) = 0 THEN 1.0::DOUBLE
        ELSE round(len(list_filter(tokens, lambda x: contains(hay, x)))::DOUBLE / len(tokens), 4) END AS ratio
    FROM t""",
)
def relevance(spark, sf_dir):
    concept = F.concat("family", F.lit(" history "), "lang", F.lit("xx "), "given")
    ratio = X.relevance_ratio(concept, F.col("title"), F.col("url"))
    return named_pages(spark, sf_dir).select("page_id", F.round(ratio, 4).alias("ratio"))


@query(
    "phrase_filter",
    rf"""
    WITH q AS (SELECT conv_id, min(turn) AS t0 FROM conversations GROUP BY conv_id),
    p AS (SELECT c.conv_id, {sql_words('c.text')} AS w FROM conversations c JOIN q ON c.conv_id = q.conv_id AND c.turn = q.t0),
    n AS (SELECT conv_id, split_part(w, ' ', 1) AS needle FROM p),
    h AS (SELECT conv_id, turn, {sql_words('text')} AS hay FROM conversations)
    SELECT h.conv_id, h.turn, needle <> '' AND contains(hay, needle) AS found,
           needle <> '' AND contains(' ' || hay || ' ', ' ' || needle || ' ') AS found_word
    FROM h JOIN n ON h.conv_id = n.conv_id""",
)
def phrase_filter(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    opening = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"))
    phrase = F.element_at(F.split(X.latin_words("opening"), " "), 1)
    return turns.join(opening, "conv_id").withColumn("phrase", phrase).select(
        "conv_id", "turn", X.phrase_in_text("phrase", "text").alias("found"),
        X.phrase_in_text("phrase", "text", whole_words=True).alias("found_word"),
    )


@query(
    "concept_label",
    f"""
    WITH c AS (SELECT text AS concept, {sql_words('text')} AS needle FROM benchmark),
    d AS (SELECT doc_id, {sql_words('text')} AS hay FROM documents),
    m AS (SELECT doc_id, concept, row_number() OVER (PARTITION BY doc_id ORDER BY length(concept) DESC, concept) AS r
          FROM d JOIN c ON needle <> '' AND contains(hay, needle))
    SELECT d.doc_id, coalesce(m.concept, '') AS concept FROM d LEFT JOIN m ON m.doc_id = d.doc_id AND m.r = 1""",
)
def label_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return concept_label(docs, "text", table(spark, sf_dir, "benchmark"), "text").select("doc_id", "concept")


@query("title_match")
def title_match(spark, sf_dir):
    """Page titles against a catalogue that misspells every other one."""
    # read three times below, and large pages have small titles
    pages = materialise(named_pages(spark, sf_dir).select("page_id", "title"), "page-titles")
    catalogue = pages.select(
        F.when(F.col("page_id") % 2 == 0, F.regexp_replace("title", "a", "e")).otherwise(F.col("title")).alias("title")
    )
    near = near_titles(pages, catalogue)
    best = near.groupBy("norm").agg(F.max_by(F.struct("match", "similarity"), F.struct("similarity", "match")).alias("b"))
    keyed = normal_title(pages, "title", "norm")
    return keyed.join(best, "norm", "left").select(
        "page_id", "b.match", F.round("b.similarity", 4).alias("similarity")
    )


_DIGEST_TITLE = "concat_ws(' ', substr(md5(url), 1, 8), substr(md5(url), 9, 8), substr(md5(url), 17, 8), substr(md5(url), 25, 8))"
#: The catalogue's spelling of a digest title: letters that no digest has at up to five places.
_MISSPELT = [5, 12, 19, 26, 33]


@query(
    "title_near",
    f"""
    WITH t AS (SELECT page_id, {_DIGEST_TITLE} AS title, CAST(page_id % 6 AS INTEGER) AS wrong FROM pages),
    m AS (SELECT page_id, title, wrong,
          {"".join(f"CASE WHEN wrong > {i} THEN 'z' ELSE substr(title, {at}, 1) END || substr(title, {at + 1}, {(_MISSPELT + [36])[i + 1] - at - 1}) || " for i, at in enumerate(_MISSPELT))}'' AS body
          FROM t)
    SELECT DISTINCT title AS norm, substr(title, 1, 4) || body AS "match", round((35 - wrong) / 35.0, 4)::DOUBLE AS similarity
    FROM m WHERE wrong <= 3""",
)
def title_near(spark, sf_dir):
    """Titles of digest letters against a catalogue with up to five letters of each replaced by one that no digest
    has: the ratio is then known, three wrong letters of 35 are near enough and four aren't."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(_DIGEST_TITLE).alias("title"))
    misspelt = F.col("title")
    for i, at in enumerate(_MISSPELT):
        misspelt = F.when(F.col("page_id") % 6 > i, F.overlay(misspelt, F.lit("z"), at)).otherwise(misspelt)
    near = near_titles(pages, pages.select(misspelt.alias("title")))
    return near.select("norm", "match", F.round("similarity", 4).alias("similarity"))


@query(
    "title_coverage",
    rf"""
    WITH {SQL_NAMED_PAGES},
    w AS (SELECT page_id, list_distinct(list_filter(regexp_extract_all(lower(regexp_replace(strip_accents(title), '[^\x00-\x7F]', '', 'g')), '[a-z]{{4,}}'),
            lambda x: x NOT IN ({', '.join(f"'{w}'" for w in rules.TITLE_STOPWORDS)}))) AS words,
            lower(regexp_replace(strip_accents(regexp_replace(html, '(?is)<title.*?</title>', '')), '[^\x00-\x7F]', '', 'g')) AS body FROM np)
    SELECT page_id, CASE WHEN len(words) >= 2
        THEN round(len(list_filter(words, lambda x: contains(body, x)))::DOUBLE / len(words), 4) END AS coverage
    FROM w""",
)
def title_coverage(spark, sf_dir):
    body = F.regexp_replace("html", "(?is)<title.*?</title>", "")
    folded = named_pages(spark, sf_dir).select(
        "page_id", X.folded_ascii("title").alias("t"), X.folded_ascii(body).alias("b")
    )
    return folded.select("page_id", F.round(X.title_coverage(F.col("t"), F.col("b")), 4).alias("coverage"))


@query(
    "ledger_validate",
    rf"""
    WITH {SQL_NAMED_PAGES},
    r AS (SELECT page_id, trim(regexp_replace(CASE WHEN page_id % 5 = 0 THEN chr(10) || ' ' ELSE title END, '\s+', ' ', 'g')) AS t,
                 CASE page_id % 4 WHEN 1 THEN 'ftp://x.org/' || page_id WHEN 2 THEN 'http:' ELSE url END AS u,
                 CASE WHEN page_id % 7 = 0 THEN repeat(family || '; ', 200) ELSE family END AS a FROM np)
    SELECT page_id, CASE WHEN t = '' THEN 'Unknown' ELSE t END AS title,
      CASE WHEN length(trim(a)) > 1000 THEN 'authors_too_long' WHEN length(u) NOT BETWEEN 8 AND 2000 THEN 'bad_url_length'
           WHEN NOT regexp_matches(u, '(?i)^https?://') THEN 'not_http' END AS reject_reason
    FROM r""",
)
def ledger_validate(spark, sf_dir):
    n = F.col("page_id")
    rows = named_pages(spark, sf_dir).select(
        "page_id",
        F.col("lang").alias("subject"),
        F.lit("s").alias("source"),
        F.when(n % 5 == 0, "\n ").otherwise(F.col("title")).alias("title"),
        F.when(n % 4 == 1, F.concat(F.lit("ftp://x.org/"), n)).when(n % 4 == 2, "http:").otherwise(F.col("url")).alias("hyperlink"),
        F.when(n % 7 == 0, F.repeat(F.concat("family", F.lit("; ")), 200)).otherwise(F.col("family")).alias("authors"),
    )
    return validate_rows(rows).select("page_id", "title", "reject_reason")


_MARKERS = ("que la", "the of", "und", "secret", "token")


@query(
    "marker_flags",
    f"""
    WITH f AS (SELECT doc_id, text, list_filter([{', '.join(f"'{m}'" for m in _MARKERS)}], lambda m: contains(lower(text), m)) AS flags FROM documents)
    SELECT doc_id, array_to_string(flags, '|') AS flags,
           md5(CASE WHEN len(flags) > 0 THEN '[withheld]' ELSE text END) AS shown FROM f""",
)
def marker_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(X.marker_flags("text", _MARKERS), "|").alias("flags"),
        F.md5(X.withhold_flagged("text", _MARKERS).cast("binary")).alias("shown"),
    )


@query(
    "quoted_spans",
    """
    WITH t AS (SELECT conv_id, turn, 'She said “' || role || '” and "' || turn || '". ' || text || ' "end' AS t FROM conversations)
    SELECT conv_id, turn, array_to_string(regexp_extract_all(t, '["“](.+?)["”]', 1)[1:3], '|') AS spans FROM t""",
)
def quoted_spans(spark, sf_dir):
    text = F.concat(F.lit("She said “"), "role", F.lit('” and "'), "turn", F.lit('". '), "text", F.lit(' "end'))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_join(X.quoted_spans(text), "|").alias("spans")
    )


def replies(spark, sf_dir):
    """Model-like replies wrapping one JSON object per document."""
    n, d = F.col("doc_id") % 5, F.col("doc_id")
    obj = F.to_json(F.struct(
        "source", d.alias("length"), (d % 7).alias("width"), F.lit(2.5).alias("height"),
        F.when(d % 2 == 0, "cm").when(d % 3 == 0, "ft").alias("units"), F.col("lang").alias("name"),
    ))
    reply = (
        F.when(n == 0, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
        .when(n == 1, F.concat(F.lit("Sure, here it is: "), obj, F.lit(" Anything else?")))
        .when(n == 2, F.concat(F.lit("["), d, F.lit("]")))
        .when(n == 3, F.concat(F.lit("{broken "), obj))
        .otherwise(obj)
    )
    return table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))


@query(
    "json_salvage",
    """
    SELECT doc_id, doc_id % 5 IN (0, 1, 4) AS parsed,
           CASE WHEN doc_id % 5 IN (0, 1, 4) THEN source END AS source FROM documents""",
)
def json_salvage(spark, sf_dir):
    found = replies(spark, sf_dir).withColumn("obj", X.salvage_json("reply"))
    return found.select("doc_id", F.col("obj").isNotNull().alias("parsed"), F.get_json_object("obj", "$.source").alias("source"))


@query(
    "validate_json",
    """
    SELECT doc_id,
      CASE WHEN doc_id % 5 NOT IN (0, 1, 4) THEN 'not_json' WHEN doc_id % 2 <> 0 AND doc_id % 3 = 0 THEN 'units'
           WHEN doc_id = 0 THEN 'length' WHEN doc_id % 7 = 0 THEN 'width' END AS invalid,
      CASE WHEN doc_id % 5 IN (0, 1, 4) AND NOT (doc_id % 2 <> 0 AND doc_id % 3 = 0) AND doc_id % 7 <> 0
           THEN CASE WHEN doc_id % 2 = 0 THEN 'cm' ELSE 'mm' END END AS units,
      CASE WHEN doc_id % 5 IN (0, 1, 4) AND NOT (doc_id % 2 <> 0 AND doc_id % 3 = 0) AND doc_id % 7 <> 0
           THEN 2.0::DOUBLE END AS wall_thickness
    FROM documents""",
)
def validated_replies(spark, sf_dir):
    found = replies(spark, sf_dir).withColumn("obj", X.salvage_json("reply"))
    checked = validate_json(found, "obj", PART_SPEC)
    return checked.select("doc_id", "invalid", "value.units", "value.wall_thickness")


# --- names -----------------------------------------------------------------------

@query(
    "clean_names",
    rf"""
    WITH {SQL_NAMED_PAGES}
    SELECT page_id,
      CASE WHEN page_id % 8 IN (0, 2, 3) THEN given || ' ' || family
           WHEN page_id % 8 = 1 THEN upper(left(given, 1)) || lower(substr(given, 2)) || ' ' || upper(left(family, 1)) || lower(substr(family, 2))
           WHEN page_id % 8 = 4 THEN family WHEN page_id % 8 = 5 THEN given || ' ' || family || '9'
           WHEN page_id % 8 = 6 THEN 'Microsoft Word ' || family ELSE 'UNESCO' END AS name,
      page_id % 8 IN (0, 1, 2, 3) AS person,
      page_id % 8 IN (0, 1, 2, 3, 6, 7) AS creator
    FROM np""",
)
def clean_names(spark, sf_dir):
    n, family, given = F.col("page_id") % 8, F.col("family"), F.col("given")
    raw = (
        F.when(n == 0, F.concat(family, F.lit(", "), given, F.lit(" (Long Form), 1839-1908")))
        .when(n == 1, F.upper(F.concat(given, F.lit(" "), family)))
        .when(n == 2, F.concat(F.lit("Dr. "), given, F.lit("  "), family, F.lit(", ed.")))
        .when(n == 3, F.concat(F.lit("Assistant Editor "), given, F.lit(" "), family))
        .when(n == 4, family)
        .when(n == 5, F.concat(given, F.lit(" "), family, F.lit("9")))
        .when(n == 6, F.concat(F.lit("Microsoft Word "), family))
        .otherwise("unesco")
    )
    named = named_pages(spark, sf_dir).select("page_id", clean_name(raw).alias("name"))
    return named.select(
        "page_id", "name", is_plausible_person(F.col("name")).alias("person"), is_plausible_creator(F.col("name")).alias("creator")
    )


@query(
    "tidy_names",
    rf"""
    WITH {SQL_NAMED_PAGES}
    SELECT page_id, given || ' ' || upper(left(family, 1)) || lower(substr(family, 2)) || ' Oké' AS name FROM np""",
)
def tidy_names(spark, sf_dir):
    raw = F.concat("given", F.lit(" "), F.upper("family"), F.lit(" Oke ́"))
    return named_pages(spark, sf_dir).select("page_id", tidy_extracted_name(raw).alias("name"))


@query(
    "split_names",
    rf"""
    WITH {SQL_NAMED_PAGES}
    SELECT page_id, 'M. ' || family || '|I. Hrbek|' || family || ', J|Ann Lee|' || given || ' Po' AS names,
           'M. ' || family || '; I. Hrbek; ' || family || ', J; et al.' AS shown
    FROM np""",
)
def split_names(spark, sf_dir):
    raw = F.concat(
        F.lit("M. "), "family", F.lit(", I. Hrbek; "), "family", F.lit(", J and Ann Lee & "), "given", F.lit(" Po; ANN LEE")
    )
    split = named_pages(spark, sf_dir).select("page_id", unique_names(split_name_list(raw)).alias("names"))
    return split.select(
        "page_id", F.array_join("names", "|").alias("names"), format_authors(F.col("names"), shown=3).alias("shown")
    )


@query("name_evidence")
def name_evidence(spark, sf_dir):
    """Is a name made of the document's first words printed in the document?"""
    words = F.regexp_extract_all(F.col("text"), F.lit(r"(\p{L}{2,})"), F.lit(1))
    docs = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", fold("text").alias("folded"), F.slice(words, 1, 2).alias("first_two"),
        F.try_element_at(words, F.lit(1)).alias("first"), F.try_element_at(words, F.lit(-1)).alias("last"),
    )
    near, far = F.concat_ws(" ", "first_two"), F.concat_ws(" ", "first", "last")
    return docs.select(
        "doc_id",
        name_in_text(near, F.col("folded")).alias("near_printed"),
        name_in_text(far, F.col("folded")).alias("far_printed"),
        surname_in_text(far, F.col("folded")).alias("surname_printed"),
    )


_PRINTED = """
    WITH d AS (SELECT doc_id, ' ' || lower(strip_accents(translate(coalesce(text, ''), chr(13) || chr(10), '  '))) || ' ' AS t FROM documents),
    w AS (SELECT doc_id, t, list_filter(regexp_extract_all(t, '[a-z]+'), lambda x: len(x) >= 3) AS w FROM d),
    n AS (SELECT doc_id, t, w[1] AS given, CASE WHEN doc_id % 3 = 0 THEN w[2] WHEN doc_id % 3 = 1 THEN w[len(w)] ELSE 'zzyzx' END AS family FROM w)
    SELECT doc_id, coalesce(regexp_matches(t, '[^a-z]' || family || '[^a-z]'), false) AS surname_printed,
           coalesce(regexp_matches(t, '[^a-z](' || given || '|' || given[1] || ')([^a-z]|[^a-z].{0,28}[^a-z])' || family || '[^a-z]|[^a-z]' || family || '\\s*,\\s*(' || given || '|' || given[1] || ')[^a-z]'), false) AS name_printed
    FROM n"""


@query("printed_names", _PRINTED)
def printed_names(spark, sf_dir):
    """Names made of two words of a document, or with a family name that no document has: are they printed in it?"""
    plain = F.translate(F.coalesce("text", F.lit("")), "\r\n", "  ")
    docs = spread(table(spark, sf_dir, "documents")).select("doc_id", fold(plain).alias("folded"))
    words = F.filter(F.regexp_extract_all("folded", F.lit("([a-z]+)"), F.lit(1)), lambda w: F.length(w) >= 3)
    n = F.pmod("doc_id", F.lit(3))
    family = F.when(n == 0, F.get("words", F.lit(1))).when(n == 1, F.try_element_at("words", F.lit(-1))).otherwise("zzyzx")
    named = docs.withColumn("words", words).withColumn("name", F.concat(F.get("words", F.lit(0)), F.lit(" "), family))
    return named.select("doc_id", surname_in_text(F.col("name"), F.col("folded")).alias("surname_printed"), name_in_text(F.col("name"), F.col("folded")).alias("name_printed"))
