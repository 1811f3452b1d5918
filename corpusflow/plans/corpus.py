"""Corpus, ledger maintenance, upload and reference-data queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusflow.functions.text import chunk_tokens
from corpusflow.functions.urls import object_key
from corpusflow.operators.joins import label_cache, unjudged_keys
from corpusflow.operators.reports import label_counts
from corpusflow.plans.common import SQL_NAMED_PAGES, named_pages, query, spread, sql_sanitize, sql_url_key, table
from corpusflow.session import scratch_dir
from corpusflow.sources import corpus as S
from corpusflow.sources import files as FI
from corpusflow.sources import ledger as L
from corpusflow.sources import reference as R
from corpusflow.sources.store import KeyedStore
from corpusflow.streaming.collect import publish_run


def _doc(name="doc_id"):
    return F.col(name)


def corpus_files(spark, sf_dir):
    """Documents as corpus files: some with front matter, some without."""
    d = _doc()
    head = F.concat(
        F.lit("---\ntitle: Document "), d, F.lit("\nregion:  "), "source", F.lit(" \nera: a:b\nnote without colon\nera: "), "lang", F.lit("\n---\n"),
    )
    raw = F.when(d % 3 == 0, F.concat(head, F.lit("\n"), "text", F.lit("\n\n"))).when(
        d % 3 == 1, F.concat(F.lit("\n---\ntitle: x\n---\n"), "text")
    ).otherwise(F.col("text"))
    path = F.concat(F.lit("/corpus/"), "lang", F.lit("/doc-"), d, F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", path.alias("source_path"), raw.alias("raw"))


@query(
    "front_matter",
    r"""
    SELECT '/corpus/' || lang || '/doc-' || doc_id || '.md' AS source_path,
      CASE WHEN doc_id % 3 = 0 THEN 'Document ' || doc_id ELSE 'doc-' || doc_id END AS title,
      CASE WHEN doc_id % 3 = 0 THEN lang END AS era, CASE WHEN doc_id % 3 = 0 THEN source END AS region,
      md5(CASE doc_id % 3 WHEN 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g')
                          WHEN 1 THEN chr(10) || '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || text ELSE text END) AS body
    FROM documents""",
)
def front_matter(spark, sf_dir):
    docs = S.parse_corpus(corpus_files(spark, sf_dir))
    return docs.select("source_path", "title", "era", "region", F.md5(F.col("body").cast("binary")).alias("body"))


def _versions(spark, sf_dir):
    """The corpus as stored, and a later delivery: new, changed and same documents."""
    d = _doc()
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), d).alias("source_path"), "doc_id", "text", "lang")
    stored = docs.where(d % 4 != 0).select(F.concat(F.lit("id"), d).alias("id"), "source_path", "lang", "text")
    delivered = docs.where(d % 4 != 3).select(
        "source_path", F.when(d % 2 == 1, F.upper("lang")).otherwise(F.col("lang")).alias("lang"),
        F.when(d % 2 == 1, F.concat(F.lit("New. "), "text")).otherwise(F.col("text")).alias("text"),
    )
    return stored, delivered


@query(
    "corpus_upsert",
    """
    SELECT CASE WHEN doc_id % 4 = 0 THEN sha256('p' || doc_id) ELSE 'id' || doc_id END AS id, 'p' || doc_id AS source_path,
           CASE WHEN doc_id % 4 = 1 THEN upper(lang) ELSE lang END AS lang,
           md5(CASE WHEN doc_id % 4 = 1 THEN 'New. ' || text ELSE text END) AS text
    FROM documents""",
)
def corpus_upsert(spark, sf_dir):
    """A delivery into a store in buckets: new and changed documents, ids of known ones stay."""
    stored, delivered = _versions(spark, sf_dir)
    store = KeyedStore(spark, scratch_dir(spark, "corpus"), "source_path", stored.schema, buckets=16)
    store.add(stored)
    store.upsert(delivered, S.upsert_documents)
    return store.read().withColumn("text", F.md5(F.col("text").cast("binary")))


@query(
    "corpus_chunks",
    r"""
    WITH v AS (SELECT 'p' || doc_id AS source_path, CASE WHEN doc_id % 4 = 1 THEN 'New. ' || text ELSE text END AS text FROM documents),
    t AS (SELECT source_path, regexp_extract_all(text, '\S+') AS tok FROM v),
    s AS (SELECT source_path, tok, unnest(range(1, greatest(1, len(tok) - 75) + 1, 425)) AS s FROM t WHERE len(tok) > 0)
    SELECT source_path, CAST((s - 1) // 425 AS INTEGER) AS chunk_index, md5(array_to_string(tok[s:s + 499], ' ')) AS digest FROM s""",
)
def corpus_chunks(spark, sf_dir):
    """Chunks after the delivery: those of touched documents are replaced."""
    stored, delivered = _versions(spark, sf_dir)
    cut = lambda df: spread(df).select(
        "source_path", F.posexplode_outer(chunk_tokens("text")).alias("chunk_index", "c")
    ).where("chunk_index IS NOT NULL").select("source_path", "chunk_index", F.md5(F.col("c.chunk").cast("binary")).alias("digest"))
    return S.replace_chunks(cut(stored), cut(delivered), delivered)


@query(
    "snapshot_diff",
    """
    SELECT 'p' || doc_id AS source_path, CASE doc_id % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'changed' WHEN 2 THEN 'same' ELSE 'deleted' END AS status
    FROM documents""",
)
def snapshot_diff(spark, sf_dir):
    stored, delivered = _versions(spark, sf_dir)
    return S.snapshot_diff(stored, delivered, "source_path", "text")


@query(
    "publish_runs",
    """
    SELECT 'p' || doc_id AS source_path, CASE WHEN doc_id % 4 = 2 THEN 1 ELSE 2 END AS run,
        len(regexp_extract_all(CASE WHEN doc_id % 4 = 1 THEN 'New. ' || text ELSE text END, '[A-Za-z]+')) AS words
    FROM documents WHERE doc_id % 4 <> 3 AND text IS NOT NULL""",
)
def publish_runs(spark, sf_dir):
    """The index after two publish runs, the second of which brings, changes and deletes documents; what didn't
    change keeps the first run's row."""
    store = KeyedStore(spark, scratch_dir(spark, "publish"), "source_path", "source_path string, digest string, words int, run int")
    count = lambda df: df.withColumn("words", F.size(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))))
    for run, snapshot in enumerate(_versions(spark, sf_dir), 1):
        whole = snapshot.select("source_path", "text")
        publish_run(whole, store, "text", lambda df: count(df).withColumn("words", F.when(F.col("text").isNotNull(), F.col("words"))), "words", run)
    return store.read().select("source_path", "run", F.col("words").cast("long").alias("words"))


@query(
    "cascade_delete",
    """
    SELECT conv_id, turn FROM conversations
    WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')""",
)
def cascade_delete(spark, sf_dir):
    """Messages left after every session with a system message is deleted."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return S.cascade_delete(turns, turns.where("role = 'system'").select("conv_id").distinct(), "conv_id").drop("role")


@query(
    "insert_absent",
    """
    SELECT n_nationkey, n_name, 'stored' AS origin FROM nation WHERE n_regionkey <> 1
    UNION ALL SELECT DISTINCT n_nationkey, n_name, 'seed' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""",
)
def insert_absent(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    stored = nation.where("n_regionkey <> 1").select("n_nationkey", "n_name", F.lit("stored").alias("origin"))
    seed = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "n_nationkey", "n_name", F.lit("seed").alias("origin")
    )
    return S.insert_absent(stored, seed, ["n_nationkey"])


# --- ledger ----------------------------------------------------------------------

def ledger_rows(spark, sf_dir):
    """Pages as ledger rows, cell by cell as text."""
    n = F.col("page_id")
    return named_pages(spark, sf_dir).select(
        n.alias("row_no"),
        F.col("lang").alias("subject"), F.lit("web").alias("source"), F.col("url").alias("hyperlink"),
        F.concat(F.lit("  "), "title", F.lit(" ")).alias("title"),
        F.when(n % 2 == 0, "TRUE").otherwise("FALSE").alias("open_source"),
        F.when(n % 3 == 0, F.concat("given", F.lit(" "), "family")).when(n % 3 == 1, "").alias("authors"),
        F.when(n % 5 == 0, "").when(n % 5 == 1, "FALSE").otherwise(" true ").alias("verdict"),
        F.when(n % 7 == 0, "TRUE").otherwise("FALSE").alias("downloaded"),
        F.when(n % 4 == 1, "failed: HTTP 404 (no longer there)").when(n % 4 == 2, "retry: HTTP 503").alias("note"),
    )


@query(
    "ledger_scan",
    rf"""
    WITH {SQL_NAMED_PAGES}
    SELECT lang AS subject, 'web' AS source, url AS hyperlink, trim(title) AS title, CASE WHEN page_id % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS open_source,
      CASE WHEN page_id % 3 = 0 THEN given || ' ' || family ELSE '' END AS authors,
      CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'FALSE' ELSE 'true' END AS verdict, CASE WHEN page_id % 7 = 0 THEN 'TRUE' ELSE 'FALSE' END AS downloaded,
      CASE page_id % 4 WHEN 1 THEN 'failed: HTTP 404 (no longer there)' WHEN 2 THEN 'retry: HTTP 503' ELSE '' END AS note
    FROM np""",
)
def ledger_scan(spark, sf_dir):
    """Write the ledger as CSV, read it back with the declared schema."""
    path = scratch_dir(spark, "ledger")
    ledger_rows(spark, sf_dir).select(*L.LEDGER_COLUMNS).write.option("header", True).option("escape", '"').csv(path)
    return L.read_ledger(spark, path)


@query(
    "guarded_backfill",
    rf"""
    WITH {SQL_NAMED_PAGES},
    l AS (SELECT page_id AS row_no, url, CASE WHEN page_id % 3 = 0 THEN given || ' ' || family ELSE '' END AS authors, family FROM np),
    o AS (SELECT *, CASE WHEN row_no % 4 = 0 THEN 'no_update' WHEN row_no % 10 = 1 THEN 'skipped_moved'
                         WHEN authors <> '' THEN 'kept' ELSE 'written' END AS outcome FROM l)
    SELECT row_no, outcome, CASE WHEN outcome = 'written' THEN 'New ' || family ELSE authors END AS authors FROM o""",
)
def guarded_backfill(spark, sf_dir):
    n = F.col("page_id")
    updates = named_pages(spark, sf_dir).select(
        n.alias("row_no"),
        F.when(n % 10 == 1, F.concat("url", F.lit("#moved"))).otherwise(F.col("url")).alias("hyperlink"),
        F.when(n % 4 != 0, F.concat(F.lit("New "), "family")).alias("value"),
    ).where("value IS NOT NULL")
    ledger = L.tidy_cells(ledger_rows(spark, sf_dir))
    return L.guarded_backfill(ledger, updates, "authors").select("row_no", "outcome", "authors")


@query(
    "pending_rows",
    f"""
    WITH l AS (SELECT page_id AS row_no, {sql_url_key('url')} AS k FROM pages
               WHERE page_id % 5 NOT IN (0, 1) AND page_id % 7 <> 0 AND page_id % 4 <> 1)
    SELECT row_no FROM l WHERE k NOT IN (SELECT {sql_url_key('url')} FROM pages WHERE page_id % 11 = 3)""",
)
def pending_rows(spark, sf_dir):
    """Approved rows still to fetch, those already published skipped."""
    rows = L.tidy_cells(ledger_rows(spark, sf_dir)).withColumn("object_key", object_key(F.lit("x"), "hyperlink"))
    published = rows.where(F.col("row_no") % 11 == 3).select("object_key")
    return L.skip_published(L.pending_rows(rows), published).select("row_no")


# --- labels ----------------------------------------------------------------------

def _labelled(spark, sf_dir):
    verdict = F.when(F.expr("quality = 1 AND toxic = 0"), True).when(F.expr("quality = 0 AND toxic = 0"), False)
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_key"), verdict.alias("verdict"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("label_key"), "lang")
    return label_cache(rows, cache)


_LABELLED = """
    l AS (SELECT d.doc_id AS label_key, lang, CASE WHEN quality = 1 AND toxic = 0 THEN true WHEN quality = 0 AND toxic = 0 THEN false END AS verdict,
                 CASE WHEN l.doc_id IS NULL THEN 'unseen' WHEN toxic <> 0 THEN 'unsure' ELSE 'labelled' END AS label_state
          FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


@query("label_cache", f"WITH {_LABELLED} SELECT label_key, lang, verdict, label_state FROM l")
def labels(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query(
    "label_counts",
    f"WITH {_LABELLED} SELECT coalesce(verdict::VARCHAR, 'unsure') AS label, count(*) AS n FROM l WHERE label_state <> 'unseen' GROUP BY 1",
)
def counts(spark, sf_dir):
    return label_counts(_labelled(spark, sf_dir))


@query(
    "unjudged_keys",
    rf"""
    WITH {SQL_NAMED_PAGES}
    SELECT DISTINCT lower(given || ' ' || family) AS label_key FROM np WHERE page_id % 6 <> 5
    EXCEPT SELECT lower(given || ' ' || family) FROM np WHERE starts_with(url, 'http://')""",
)
def unjudged(spark, sf_dir):
    pages = named_pages(spark, sf_dir).withColumn("full", F.concat("given", F.lit(" "), "family"))
    rows = pages.select(
        F.when(F.col("page_id") % 6 == 5, F.concat(F.lit("Unknown ; "), "full")).otherwise(
            F.concat(F.lit(" "), "full", F.lit(" ; Second Author"))
        ).alias("authors")
    )
    cache = pages.where("url LIKE 'http://%'").select(F.lower("full").alias("label_key")).distinct()
    return unjudged_keys(rows, cache)


# --- files -----------------------------------------------------------------------

def uploaded_files(spark, sf_dir):
    """Documents as uploads of several true types, some mislabelled."""
    d = _doc()
    magic = {0: "255044462D312E37", 1: "89504E470D0A1A0A", 2: "FFD8FF", 3: "474946383961", 4: "52494646000000005745425056503820",
             5: "504B0304776F72642F646F63756D656E742E786D6C", 6: "504B0304", 7: "4D5A", 8: "FF"}
    head = F.lit("")
    for i, value in magic.items():
        head = F.when(d % 12 == i, value).otherwise(head)
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".TXT", ".json", ".md")]), (d % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("file."), d, suffix).alias("filename"),
        F.concat(F.unhex(head), F.col("text").cast("binary")).alias("content"),
    )


@query(
    "sniff_types",
    """
    SELECT doc_id, CASE doc_id % 12 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/gif'
        WHEN 4 THEN 'image/webp' WHEN 5 THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN 6 THEN NULL WHEN 8 THEN NULL
        ELSE CASE doc_id % 4 WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/json' WHEN 3 THEN 'text/markdown' END END AS content_type
    FROM documents""",
)
def sniff_types(spark, sf_dir):
    files = uploaded_files(spark, sf_dir)
    return files.select("doc_id", FI.sniff_type(F.col("content"), F.col("filename")).alias("content_type"))


@query(
    "extract_status",
    rf"""
    WITH r AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{{' || chr(10) || '  "source": "' || source || '",' || chr(10) || '  "list": [' || chr(10) || '    1,' || chr(10) || '    ' || doc_id || chr(10) || '  ]' || chr(10) || '}}'
                                WHEN 1 THEN '' WHEN 2 THEN NULL ELSE text END AS raw FROM documents),
    c AS (SELECT doc_id, raw, {sql_sanitize('raw')} AS clean FROM r)
    SELECT doc_id,
      CASE WHEN clean IS NULL THEN 'failed' WHEN clean = '' THEN 'empty' WHEN length(clean) > 20000 THEN 'truncated' ELSE 'ok' END AS extraction_status,
      CAST(length(raw) - length(replace(raw, chr(10), '')) + 1 AS INTEGER) AS line_count,
      CASE WHEN length(clean) > 20000 THEN 20000 END AS truncated_to_chars,
      CASE WHEN clean <> '' THEN md5(left(clean, 20000)) END AS digest
    FROM c""",
)
def extract_status(spark, sf_dir):
    d = _doc()
    text = (
        F.when(d % 5 == 0, F.concat(F.lit('{"source":"'), "source", F.lit('","list":[1,'), d, F.lit("]}")))
        .when(d % 5 == 1, "").when(d % 5 == 3, F.col("text")).when(d % 5 == 4, F.col("text"))
    )
    decoded = spread(table(spark, sf_dir, "documents")).select(
        "doc_id", text.alias("text"), F.when(d % 5 == 0, "application/json").otherwise("text/plain").alias("content_type")
    )
    return FI.extract_text(decoded).select(
        "doc_id", "extraction_status", "line_count", "truncated_to_chars",
        F.md5(F.col("extracted_text").cast("binary")).alias("digest"),
    )


@query(
    "sidecar_json",
    rf"""
    WITH {SQL_NAMED_PAGES},
    a AS (SELECT page_id, left(repeat(replace(replace(title, '"', ''), chr(92), '') || ' ', CAST(1 + page_id % 6 AS INTEGER)), 300) AS title,
             left(repeat(family || '; ', CAST(1 + page_id % 40 AS INTEGER)), 200) AS author,
             url || repeat('/é', CAST(page_id % 3 * 200 AS INTEGER)) AS u, repeat(lang, CAST(1 + page_id % 5 * 80 AS INTEGER)) AS concept FROM np),
    b AS (SELECT *, '", "author": "' || author || '", ' AS mid, '"host": "h", "concept": "' || concept || '", "open_access": ' || (page_id % 2 = 0)::VARCHAR || '}}}}' AS post,
             '{{"metadataAttributes": {{"title": "' AS pre FROM a),
    f AS (SELECT *, pre || title || mid || '"source_url": "' || u || '", ' || post AS full_body FROM b),
    s AS (SELECT *, list_filter(list_transform(range(0, 16), lambda k: left(title, greatest(0, length(title) - k * 20))),
                       lambda t: strlen(pre || t || mid || post) <= 1000) AS fits FROM f)
    SELECT page_id, CASE WHEN strlen(full_body) <= 1000 THEN full_body ELSE pre || coalesce(fits[1], '') || mid || post END AS sidecar FROM s""",
)
def sidecars(spark, sf_dir):
    n = F.col("page_id")
    plain = F.replace(F.replace("title", F.lit('"'), F.lit("")), F.lit("\\"), F.lit(""))
    rows = named_pages(spark, sf_dir).select(
        "page_id",
        F.repeat(F.concat(plain, F.lit(" ")), (n % 6 + 1).cast("int")).alias("title"),
        F.repeat(F.concat("family", F.lit("; ")), (n % 40 + 1).cast("int")).alias("author"),
        F.concat("url", F.repeat(F.lit("/é"), (n % 3 * 200).cast("int"))).alias("source_url"),
        F.lit("h").alias("host"),
        F.repeat("lang", (n % 5 * 80 + 1).cast("int")).alias("concept"),
        (n % 2 == 0).alias("open_access"),
    )
    return FI.sidecar_json(rows).select("page_id", "sidecar")


# --- reference data --------------------------------------------------------------

@query(
    "reference_lookup",
    """
    WITH c AS (SELECT lower(p_type) AS slug, count(*) AS machines, max(p_retailprice) AS dearest FROM part WHERE p_type <> 'SMALL' GROUP BY 1)
    SELECT s_suppkey, r_name AS region, machines, dearest, n AS nations
    FROM (SELECT s_suppkey, lower(['ECONOMY','SMALL','LARGE','PROMO','STANDARD'][CAST(s_suppkey % 5 + 1 AS INTEGER)]) AS slug, r_name
          FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) s
    LEFT JOIN c ON s.slug = c.slug
    LEFT JOIN (SELECT r_name AS rn, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 GROUP BY 1) x ON x.rn = r_name""",
)
def reference_lookup(spark, sf_dir):
    """Suppliers' requests with category and region references, either may be missing."""
    geo = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    kinds = F.array(*[F.lit(x) for x in ("ECONOMY", "SMALL", "LARGE", "PROMO", "STANDARD")])
    requests = table(spark, sf_dir, "supplier").join(geo, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.element_at(kinds, (F.col("s_suppkey") % 5 + 1).cast("int")).alias("category"), F.col("r_name").alias("region")
    )
    categories = table(spark, sf_dir, "part").where("p_type <> 'SMALL'").groupBy(
        R.category_slug("p_type").alias("slug"), F.col("p_type").alias("category")
    ).agg(F.count("*").alias("machines"), F.max("p_retailprice").alias("dearest"))
    regions = geo.where("r_regionkey <> 2").groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("nations"))
    return R.attach_reference(requests, categories, regions).select("s_suppkey", "region", "machines", "dearest", "nations")
