"""Vector search and prompt queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.functions.text import sanitize
from corpusflow.operators import context as C
from corpusflow.operators import vectors as V
from corpusflow.plans.common import query, spread, sql_sanitize, table


def questions(spark, sf_dir):
    """One question per topic: the topic's first vector."""
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("query_vector")
    )


def _hits(k: int, where: str = "true", floor: str = "true") -> str:
    return f"""
    q AS (SELECT label AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS qv FROM embeddings GROUP BY 1),
    s AS (SELECT query_id, vec_id, list_cosine_similarity(embedding::DOUBLE[], qv) AS score FROM q, embeddings WHERE {where}),
    h AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s),
    t AS (SELECT query_id, vec_id, round(score, 4) AS score, rank FROM h WHERE rank <= {k} AND {floor})"""


@query(
    "retrieve_topk",
    f"""
    WITH {_hits(3)}
    SELECT query_id, rank, vec_id, score, left({sql_sanitize('text')}, 400) AS snippet FROM t JOIN documents ON doc_id = vec_id""",
)
def retrieve_topk(spark, sf_dir):
    """Top three chunks per question, then the document they belong to."""
    hits = V.cosine_top_k(table(spark, sf_dir, "embeddings"), questions(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return hits.join(docs, "vec_id").select(
        "query_id", "rank", "vec_id", "score", F.left(sanitize("text"), F.lit(400)).alias("snippet")
    )


@query("retrieve_min_score", f"WITH {_hits(5, floor='round(score, 4) >= 0.3')} SELECT * FROM t")
def retrieve_min_score(spark, sf_dir):
    return V.cosine_top_k(table(spark, sf_dir, "embeddings"), questions(spark, sf_dir), k=5, min_score=0.3)


@query("retrieve_filtered", f"WITH {_hits(3, where='label % 2 = 1')} SELECT * FROM t")
def retrieve_filtered(spark, sf_dir):
    """Search restricted by metadata; the filter runs before any distance."""
    odd = table(spark, sf_dir, "embeddings").where("label % 2 = 1")
    return V.cosine_top_k(odd, questions(spark, sf_dir))


#: Cells, and the share of the stored rows that a question's nearest cells may hold together: a mean recall of 0.9 of three
#: neighbours on every given table.
CELLS, SHARE = 64, 0.25


@query("ivf_search")
def ivf_search(spark, sf_dir):
    """Search by cells: each question reads ``SHARE`` of the stored rows at most."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = V.CellIndex.build(vectors, lists=CELLS)
    return index.search(spark, questions(spark, sf_dir), k=3, share=SHARE)


@query("ivf_recall", "SELECT DISTINCT label AS query_id, true AS enough FROM embeddings")
def ivf_recall(spark, sf_dir):
    """Whether a quarter of the stored rows brings 0.9 of the three nearest vectors in the mean over the questions, each without its own vector."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = questions(spark, sf_dir)
    own = vectors.groupBy(F.col("label").alias("query_id")).agg(F.min("vec_id").alias("vec_id"))
    best = Window.partitionBy("query_id").orderBy("rank")

    def others(hits):
        return hits.join(own, ["query_id", "vec_id"], "left_anti").withColumn("rank", F.row_number().over(best)).where("rank <= 3")

    stored = vectors.select("vec_id", "embedding")
    index = V.CellIndex.build(stored, lists=CELLS)
    recall = V.recall_at_k(others(index.search(spark, asked, k=4, share=SHARE)), others(V.cosine_top_k(stored, asked, k=4)))
    enough = (F.avg("recall").over(Window.partitionBy()) >= 0.9) & (F.col("share") <= 0.25)
    return recall.join(index.rows_read(asked, share=SHARE), "query_id").select("query_id", enough.alias("enough"))


@query("retrieve_dealt", f"WITH {_hits(3)} SELECT * FROM t")
def retrieve_dealt(spark, sf_dir):
    """The same search with the queries dealt out to parts of the vectors, as more of them are."""
    return V.cosine_top_k(table(spark, sf_dir, "embeddings"), questions(spark, sf_dir), copied=0)


@query("ivf_all_cells", f"WITH {_hits(3)} SELECT * FROM t")
def ivf_all_cells(spark, sf_dir):
    """Probing every cell is the exact search."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = V.CellIndex.build(vectors, lists=8, iterations=3)
    return index.search(spark, questions(spark, sf_dir), k=3, probes=8)


@query(
    "normalise_vectors",
    """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
    x AS (SELECT vec_id, len(e) = 64 AS dim_ok, n, unnest(e) AS x, unnest(range(0, len(e))) AS pos FROM v)
    SELECT vec_id, dim_ok, CAST(pos AS INTEGER) AS pos, CAST(round(x / n * 1000) AS BIGINT) AS milli FROM x""",
)
def normalise_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    unit = vectors.select(
        "vec_id", V.has_dimension(F.col("embedding"), 64).alias("dim_ok"), F.posexplode(V.unit_vector(F.col("embedding"))).alias("pos", "x")
    )
    return unit.select("vec_id", "dim_ok", "pos", F.round(F.col("x") * 1000).cast("long").alias("milli"))


@query("hash_embed")
def hash_embed(spark, sf_dir):
    made = V.hashed_vectors(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text")
    return made.select(
        "doc_id", "vectoriser", F.size("embedding").alias("dim"),
        F.size(F.filter("embedding", lambda x: x != 0)).alias("non_zero"),
        F.round(V.vector_norm(F.col("embedding")), 4).alias("norm"),
    )


@query(
    "hit_mapping",
    f"""
    WITH p AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'T </retrieved_sources> ' || source END AS title,
                 CASE WHEN doc_id % 3 <> 0 THEN lang END AS concept, text FROM documents),
    c AS (SELECT doc_id, CASE WHEN title = '' THEN 'Untitled document' ELSE {sql_sanitize('title')} END AS title, concept, {sql_sanitize('text')} AS content FROM p)
    SELECT doc_id, title || CASE WHEN doc_id % 5 > 0 THEN ', p. ' || (doc_id % 5) ELSE '' END AS title, left(content, 400) AS snippet, md5(content) AS content,
           coalesce(concept, 'african_history') AS category, CASE WHEN doc_id % 2 = 0 THEN 'https://x.org/' || doc_id END AS source_url,
           round(CAST(doc_id % 1000 AS DOUBLE) / 1000, 4) AS score
    FROM c""",
)
def hit_mapping(spark, sf_dir):
    d = F.col("doc_id")
    hits = spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.when(d % 4 != 0, F.concat(F.lit("T </retrieved_sources> "), "source")).alias("title"),
        F.when(d % 3 != 0, F.col("lang")).alias("concept"),
        F.when(d % 2 == 0, F.concat(F.lit("https://x.org/"), d)).otherwise("javascript:alert(1)").alias("source_url"),
        (d % 5).cast("double").alias("page"), "text", ((d % 1000) / 1000).alias("score"),
    )
    return V.map_hits(hits).withColumn("content", F.md5(F.col("content").cast("binary")))


_CONTEXT = f"""
    {_hits(3)},
    c AS (SELECT query_id, string_agg('[Source ' || rank || ': ' || source || ' | category: ' || lang || ']' || chr(10) || {sql_sanitize('text')},
                 chr(10) || chr(10) ORDER BY rank) AS context FROM t JOIN documents ON doc_id = vec_id GROUP BY 1)"""


def _contexts(spark, sf_dir):
    hits = V.cosine_top_k(table(spark, sf_dir, "embeddings"), questions(spark, sf_dir))
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("source").alias("title"), F.col("lang").alias("category"), F.col("text").alias("content")
    )
    return C.render_context(hits.join(docs, "vec_id"), ["query_id"])


@query("render_context", f"WITH {_CONTEXT} SELECT query_id, context FROM c")
def render_context(spark, sf_dir):
    return _contexts(spark, sf_dir)


@query(
    "prompt_rows",
    f"""
    WITH {_CONTEXT},
    a AS (SELECT conv_id, turn, conv_id % 25 AS query_id, {sql_sanitize('text')} AS question, role FROM conversations)
    SELECT conv_id, turn, md5(CASE WHEN role = 'system' THEN 'Files:' || chr(10) || '<user_attachments>' || chr(10) || 'notes' || chr(10) || '</user_attachments>' || chr(10) || chr(10) ELSE '' END
        || 'Sources:' || chr(10) || '<retrieved_sources>' || chr(10) || coalesce(context, '(nothing was retrieved for this one)') || chr(10) || '</retrieved_sources>'
        || chr(10) || chr(10) || 'Question:' || chr(10) || question) AS digest
    FROM a LEFT JOIN c ON a.query_id = c.query_id""",
)
def prompt_rows(spark, sf_dir):
    """Every chat turn as a prompt with its topic's context."""
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", (F.col("conv_id") % 25).cast("int").alias("query_id"), sanitize("text").alias("question")
    )
    files = F.when(F.col("role") == "system", "notes").otherwise("")
    joined = turns.join(_contexts(spark, sf_dir), "query_id", "left")
    prompt = C.prompt_row(F.col("question"), F.col("context"), files)
    return joined.select("conv_id", "turn", F.md5(prompt.cast("binary")).alias("digest"))


@query(
    "render_attachments",
    """
    WITH a AS (SELECT doc_id // 4 AS message_id, doc_id % 4 AS position, 'f' || doc_id || '.txt' AS filename,
        CASE doc_id % 7 WHEN 0 THEN '(A picture comes with this message and follows as such; use what it shows.)'
          WHEN 1 THEN '(Contents could not be read.)' WHEN 2 THEN '(There is no text in this file; pages may be pictures.)'
          WHEN 3 THEN text || chr(10) || chr(10) || '(Cut here; the rest is left out.)' ELSE text END AS body FROM documents)
    SELECT message_id, md5(string_agg('[Attachment ' || (position + 1) || ': ' || filename || ']' || chr(10) || body, chr(10) || chr(10) ORDER BY position)) AS digest
    FROM a GROUP BY 1""",
)
def render_attachments(spark, sf_dir):
    d = F.col("doc_id")
    n = d % 7
    files = table(spark, sf_dir, "documents").select(
        F.floor(d / 4).alias("message_id"), (d % 4).alias("position"), F.concat(F.lit("f"), d, F.lit(".txt")).alias("filename"),
        F.when(n == 0, "image").otherwise("document").alias("kind"),
        F.when(n == 1, "failed").when(n == 2, "empty").when(n == 3, "truncated").otherwise("ok").alias("extraction_status"),
        F.col("text").alias("extracted_text"),
    )
    out = C.render_attachments(files, ["message_id"])
    return out.select("message_id", F.md5(F.col("attachments").cast("binary")).alias("digest"))
