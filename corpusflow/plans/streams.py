"""Streaming queries, run over everything the tables hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusflow.functions.urls import normalise_url
from corpusflow.plans.activity import _STREAKS
from corpusflow.plans.common import ORACLES, SQL_NAMED_PAGES, query, sql_url_key, sql_words, table
from corpusflow.plans.discovery import _EXPECTED, _KEYS, _expected, landed, landed_everywhere
from corpusflow.session import materialise, scratch_dir
from corpusflow.streaming import collect as C
from corpusflow.streaming import limits as L


#: Files of a delivery; a batch is that many, so a batch is work for many tasks and the number of batches doesn't grow with the table.
DELIVERY_FILES = 12


def landed_events(spark, sf_dir, *columns):
    """Events as a stream of files, up to a week out of order: five days to a delivery, with what was held up for one or
    two days; the end marker comes last."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", *columns)
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    folder = f"{scratch_dir(spark, 'events')}/landing"
    days = F.datediff("ts", F.lit(first)) + F.pmod(F.xxhash64("event_id"), F.lit(3))
    late = events.withColumn("delivery", F.floor(days / 5))
    for delivery in range(((last - first).days + 3) // 5 + 1):
        late.where(F.col("delivery") == delivery).drop("delivery").repartition(DELIVERY_FILES).write.mode("append").parquet(folder)
    L.end_marker(spark, events.schema, "ts", F.lit(last) + F.expr("INTERVAL 100 DAYS")).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", DELIVERY_FILES).parquet(folder)


def _run(spark, stream, purpose):
    folder = scratch_dir(spark, purpose)
    return C.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint")


@query("rate_limit_stream", ORACLES["rate_limit"])
def rate_limit_stream(spark, sf_dir):
    L.prepare_state_store(spark)
    hits = landed_events(spark, sf_dir, F.col("event_type").alias("path"))
    decided = L.rate_limit_stream(hits, ["user_id", "path"], "ts", "event_id", limit=2, window_seconds=172_800, late="8 days")
    return _run(spark, decided.select("event_id", "hit_no", "allowed", "retry_after"), "rate-limit")


@query("streak_stream", f"WITH {_STREAKS} SELECT event_id, streak FROM s")
def streak_stream(spark, sf_dir):
    L.prepare_state_store(spark)
    calls = landed_events(spark, sf_dir, "event_type")
    out = L.streak_stream(calls, ["user_id"], "ts", "event_id", F.col("event_type") == "error", late="8 days", idle_seconds=60 * 86_400)
    return _run(spark, out.select("event_id", "streak"), "streaks")


@query(
    "stream_new_urls",
    f"""
    SELECT DISTINCT {sql_url_key('url')} AS url_key FROM pages
    EXCEPT SELECT {sql_url_key('url')} FROM pages WHERE starts_with(url, 'http://m.')""",
)
def stream_new_urls(spark, sf_dir):
    """Every page is landed twice, in files that are batches of their own; each address comes out once."""
    known = table(spark, sf_dir, "pages").where("url LIKE 'http://m.%'").select(normalise_url("url").alias("url_key"))
    folder = f"{scratch_dir(spark, 'landed')}/pages"
    pages = table(spark, sf_dir, "pages").select("url", F.timestamp_seconds(F.col("page_id") * 3_600 + 1_700_000_000).alias("ts"))
    pages.union(pages.withColumn("ts", F.col("ts") + F.expr("INTERVAL 90 DAYS"))).repartition(5).write.parquet(folder)
    L.prepare_state_store(spark)
    hits = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return _run(spark, C.new_url_stream(hits, known, "url", "ts").select("url_key"), "new-urls")


@query(
    "clock_windows",
    """
    SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS opened, count(*) AS hits FROM events GROUP BY 1, 2""",
)
def clock_windows(spark, sf_dir):
    """Requests per user and day, from files out of order; the end marker closes the last days."""
    counted = L.clock_windows(landed_events(spark, sf_dir), ["user_id"], "ts", window_seconds=86_400, late="8 days")
    out = counted.select("user_id", F.col("window.start").alias("opened"), "hits")
    return _run(spark, out, "clock").withColumn("opened", F.col("opened").cast("timestamp_ntz"))


@query(
    "stream_harvest",
    rf"""
    WITH {SQL_NAMED_PAGES},
    r AS ({" UNION ALL ".join(_expected(k) for k in _KEYS)}),
    s AS (SELECT *, {sql_url_key('url')} AS url_key FROM r WHERE contains({sql_words('title')}, {sql_words('concept')}))
    SELECT DISTINCT url_key FROM s WHERE length(url) BETWEEN 8 AND 2000""",
)
def stream_harvest(spark, sf_dir):
    """Landed pages of every catalogue into the ledger, in three batches; keys of what arrived."""
    folder = scratch_dir(spark, "harvest")
    landed_everywhere(spark, sf_dir).repartition(3 * DELIVERY_FILES).write.parquet(f"{folder}/landing")
    stream = C.read_landing(spark, f"{folder}/landing", files_per_batch=DELIVERY_FILES)
    C.harvest_stream(stream, f"{folder}/ledger", f"{folder}/checkpoint").awaitTermination()
    return C.ledger(spark, f"{folder}/ledger").select("url_key")


@query(
    "walk_resume",
    """
    WITH a AS (SELECT 'repo' || CAST(page_id % 8 AS VARCHAR) AS source, row_number() OVER (PARTITION BY page_id % 8 ORDER BY page_id) AS seq FROM pages),
    k AS (SELECT *, CASE WHEN seq % 7 = 0 THEN 'error' WHEN seq % 5 = 0 THEN 'unreadable' WHEN seq % 11 = 0 THEN 'last' ELSE 'page' END AS kind FROM a),
    c AS (SELECT *, CASE kind WHEN 'page' THEN 't' || CAST(seq AS VARCHAR) WHEN 'unreadable' THEN NULL ELSE '' END AS code FROM k),
    w AS (SELECT *, coalesce(last_value(code IGNORE NULLS) OVER (PARTITION BY source ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS cursor FROM c)
    SELECT source, seq, CASE WHEN kind = 'page' THEN 'taken' WHEN kind = 'last' THEN 'finished' WHEN kind = 'error' AND cursor <> '' THEN 'restarted' ELSE 'failed' END AS status,
           CASE WHEN kind = 'page' THEN code WHEN kind = 'unreadable' THEN nullif(cursor, '') END AS token FROM w
    UNION ALL SELECT source, seq, 'stale', NULL FROM w WHERE seq % 4 = 0""",
)
def walk_resume(spark, sf_dir):
    """Walks through eight repositories, stopped half-way and taken up again; tokens expire, answers break, and some come twice."""
    in_order = Window.partitionBy("source").orderBy("seq")
    source = F.concat(F.lit("repo"), F.col("page_id") % 8)
    answers = table(spark, sf_dir, "pages").select(source.alias("source"), F.col("page_id")).withColumn("seq", F.row_number().over(Window.partitionBy("source").orderBy("page_id")).cast("long"))
    n = F.col("seq")
    kind = F.when(n % 7 == 0, "error").when(n % 5 == 0, "unreadable").when(n % 11 == 0, "last").otherwise("page")
    token = F.concat(F.lit("t"), n)
    code = F.when(kind == "page", token).when(kind != "unreadable", F.lit(""))
    asked = F.last(code, ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    answer = F.concat(
        F.lit("<OAI-PMH><ListRecords><record><header><identifier>oai:1</identifier></header></record><resumptionToken>"),
        F.when(kind == "page", token).otherwise(""), F.lit("</resumptionToken></ListRecords></OAI-PMH>"),
    )
    payload = F.when(kind == "error", '<OAI-PMH><error code="badResumptionToken">gone</error></OAI-PMH>').when(kind == "unreadable", "<html>").otherwise(answer)
    quarter = F.floor(n * 4 / (F.count("*").over(Window.partitionBy("source")) + 1))
    landed = materialise(answers.select("source", "seq", F.nullif(asked, F.lit("")).alias("asked"), payload.alias("payload"), quarter.alias("quarter")), "walks")
    folder = scratch_dir(spark, "walks")
    L.prepare_state_store(spark)

    def deliver(rows):
        # a source's answers of a delivery are in one file
        rows.drop("quarter").repartition(2, "source").write.mode("append").parquet(f"{folder}/landing")

    def go_on():
        stream = spark.readStream.schema("source string, seq long, asked string, payload string").option("maxFilesPerTrigger", 4).parquet(f"{folder}/landing")
        return C.run_to_table(C.walk_stream(stream).select("source", "seq", "status", "token"), f"{folder}/out", f"{folder}/checkpoint")

    for part in range(2):
        deliver(landed.where(F.col("quarter") == part))
    go_on()
    for part in range(2, 4):
        deliver(landed.where(F.col("quarter") == part))
    deliver(landed.where(F.col("seq") % 4 == 0))
    return go_on()


@query(
    "harvest_redirects",
    rf"""
    WITH {SQL_NAMED_PAGES},
    r AS (SELECT page_id % 3 AS batch, lang, title, {_EXPECTED["hal"][0]} AS u FROM np),
    s AS (SELECT {sql_url_key('u')} AS k, min(batch) AS batch FROM r
          WHERE contains({sql_words('title')}, {sql_words('lang')}) AND length(u) BETWEEN 8 AND 2000 GROUP BY 1),
    f AS (SELECT *, {sql_url_key("CASE WHEN length(k) % 2 = 1 THEN regexp_replace(k, '^(https?://[^/]*).*$', '" + chr(92) + "1') ELSE k END")} AS fk FROM s),
    w AS (SELECT *, row_number() OVER (PARTITION BY fk ORDER BY batch, CASE WHEN fk = k THEN 0 ELSE 1 END, k) AS place FROM f)
    SELECT k AS url_key, fk AS final_key FROM w WHERE place = 1""",
)
def harvest_redirects(spark, sf_dir):
    """Answers of a catalogue in three batches; addresses of odd length redirect to their site, which one of them may claim."""
    folder = scratch_dir(spark, "redirects")
    answers = materialise(landed(spark, sf_dir, "hal"), "answers")
    for part in range(3):
        delivery = answers.where(F.col("page_id") % 3 == part).select("source", "concept", "payload")
        delivery.coalesce(1).write.mode("append").parquet(f"{folder}/landing")
    final = F.when(F.length("url_key") % 2 == 1, F.regexp_extract("url_key", "^(https?://[^/]*)", 1)).otherwise(F.col("url_key"))
    probed = materialise(C.ledger_candidates(answers).select("url_key").distinct().withColumn("final_url", final), "probes")
    stream = C.read_landing(spark, f"{folder}/landing", files_per_batch=1)
    C.harvest_stream(stream, f"{folder}/ledger", f"{folder}/checkpoint", redirects=lambda: probed).awaitTermination()
    moved = normalise_url("hyperlink") != F.col("url_key")
    to_site = (F.length("url_key") % 2 == 1) & moved
    return C.ledger(spark, f"{folder}/ledger").select("url_key", F.when(to_site, normalise_url("hyperlink")).otherwise(F.col("url_key")).alias("final_key"))
