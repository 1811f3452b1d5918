"""The registered query of each operator, with its oracle where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.bpe import decode, encode
from corpusflow.llm.common import id_and_text, prepare
from corpusflow.llm.divergence import source_divergence
from corpusflow.llm.lexical import search
from corpusflow.llm.minhash import near_duplicates
from corpusflow.llm.mixing import mix
from corpusflow.llm.packing import pack_documents
from corpusflow.llm.quality import held_out, learn_quality, quality_score
from corpusflow.llm.secrets import find_secrets
from corpusflow.llm.spotsigs import fingerprint_text, followed, pruned_jaccard, signatures
from corpusflow.llm.token_files import token_files
from corpusflow.llm.url_rules import judge_urls
from corpusflow.llm.vantage import nearest_neighbours
from corpusflow.llm.warc import archive_and_read_back

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op1_minhash_near_dedup",
    r"""
    WITH RECURSIVE d AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (
      SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
    c AS (SELECT sh, min(doc_id) AS node, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
    x AS (SELECT node, n, unnest(sh) AS g FROM c),
    p AS (SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
          FROM x a JOIN x b ON a.g = b.g AND a.node < b.node GROUP BY 1, 2),
    e AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT node, node AS seen FROM c UNION SELECT r.node, b FROM r JOIN both_ways ON a = seen),
    m AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
    SELECT doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, doc_id = coalesce(component, doc_id) AS kept
    FROM s LEFT JOIN c ON s.sh = c.sh LEFT JOIN m ON m.node = c.node
    """,
)
def op1(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


@query(
    "op5_url_rules",
    rf"""
    WITH parts AS (
      SELECT page_id,
             coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
    ruled AS (
      SELECT *, CASE WHEN {_fits("example.net", "/en/")} THEN 'example.net/en/' WHEN {_fits("example.com", "/de/")} THEN 'example.com/de/'
                     WHEN {_fits("org", "/fr/")} THEN 'org/fr/' WHEN {_fits("net", "/")} THEN 'net/' END AS rule
      FROM parts)
    SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
    """,
)
def op5(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


@query("op6_quality_classifier")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = learn_quality(docs, table(spark, sf_dir, "labels"))
    scored = id_and_text(docs).select("doc_id", held_out().alias("held_out"), quality_score(F.col("text"), model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op7_secret_scan")
def op7(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))  # noqa: E731
    return found.select(
        "doc_id",
        *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(_joined(of("assign", "access", "hex")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


@query(
    "op8_nearest_neighbours",
    """
    WITH usable AS (
      SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    normed AS (SELECT vec_id, v, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS n FROM usable),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             list_reduce(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]), lambda a, b: a + b) / (q.n * c.n) AS score
      FROM normed q, normed c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
    ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
)
def op8(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=1.0)


@query("op9_byte_bpe")
def op9(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = decode(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op10_token_files")
def op10(spark, sf_dir):
    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)


@query(
    "op3_warc_index",
    """
    WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
    f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
    SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
           CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
    FROM p LEFT JOIN f ON p.digest = f.digest
    """,
)
def op3(spark, sf_dir):
    return archive_and_read_back(table(spark, sf_dir, "pages"))


@query("op4_spot_signatures")
def op4(spark, sf_dir):
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    found = followed(table(spark, sf_dir, "documents")).withColumn("edited", edited)
    found = found.withColumn("edited_spots", signatures(F.col("edited")))
    return found.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("spots")).alias("fingerprint"),
        fingerprint_text(F.col("edited_spots")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        pruned_jaccard(F.col("spots"), F.col("next_spots")).alias("near_next"),
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_source_divergence",
    rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
    tok AS (SELECT r, lang, source, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS lang_n FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    cnt AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
    grp AS (SELECT DISTINCT lang, source FROM d),
    v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
    g AS (SELECT grp.lang, grp.source, coalesce(any_value(v.v), 0) AS v, any_value(lang_total) AS lang_total, coalesce(sum(cnt.n), 0) AS total
          FROM grp LEFT JOIN v ON v.lang = grp.lang LEFT JOIN cnt ON cnt.lang = grp.lang AND cnt.source = grp.source GROUP BY 1, 2),
    p AS (SELECT g.lang, g.source, kept.term, coalesce(cnt.n, 0) AS n,
                 1 + (1000000000::HUGEINT * (coalesce(cnt.n, 0) + 5)) // (total + 5 * v) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v) AS q
          FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = kept.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    found AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
      FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
      UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
    ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
                      CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
    """,
)
def op11(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


@query(
    "op12_ranked_search",
    rf"""
    WITH tok AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
    post AS (SELECT doc_id, t, count(*) AS tf FROM tok GROUP BY 1, 2),
    whole AS (SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS n_terms FROM tok),
    long AS (SELECT doc_id, 50 + (50 * count(*) * any_value(n_docs)) // any_value(n_terms) AS m FROM tok, whole GROUP BY doc_id),
    asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
    weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, whole GROUP BY t),
    scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
               FROM asked JOIN weights USING (t) JOIN post USING (t) JOIN long USING (doc_id) GROUP BY 1, 2),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT * FROM ranked WHERE rank <= 50
    """,
)
def op12(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


@query(
    "op13_mix_sources",
    r"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw,
                      CAST(coalesce(len(regexp_extract_all(text, '[^ 	-]+')), 0) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, sum(source_size) OVER () AS everything FROM s),
    -- sources by the level that fills them; the level that serves all others from there on
    f AS (SELECT *, source_size / weight AS fills, coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS smaller,
                 sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM w),
    l AS (SELECT CAST(3 * everything - 4 * smaller AS BIGINT) AS up, CAST(2 * others AS BIGINT) AS down FROM f
          WHERE (3 * everything - 4 * smaller) * weight < 4 * others * source_size ORDER BY fills, source NULLS LAST LIMIT 1),
    t AS (SELECT source, source_size,
                 CASE WHEN up IS NULL OR CAST(weight AS HUGEINT) * up >= CAST(2 * source_size AS HUGEINT) * down THEN CAST(2 * source_size AS DOUBLE)
                      ELSE CAST(weight * up AS DOUBLE) / CAST(down AS DOUBLE) END AS target FROM w LEFT JOIN l ON true),
    q AS (SELECT r, doc_id, d.source, draw, size, source_size, target,
                 sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS LAST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    e AS (SELECT q.*, pass, coalesce(CAST(pass * source_size + upto AS DOUBLE) / nullif(target, 0), 0) AS finish FROM q, (SELECT unnest([0, 1]) AS pass)),
    a AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, pass, draw, doc_id NULLS LAST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS ahead FROM e)
    SELECT doc_id, size, source_size, target,
           CAST(sum(greatest(0, least(size, (SELECT any_value(everything) FROM w) * 3 // 2 - ahead))) AS BIGINT) AS taken FROM a GROUP BY r, doc_id, size, source_size, target
    """,
)
def op13(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
