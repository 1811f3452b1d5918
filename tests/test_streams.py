import json
from datetime import datetime, timedelta
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusflow.operators import ordered as O
from corpusflow.operators.matching import concept_label
from corpusflow.sources.store import KeyedStore
from corpusflow.streaming import collect as C
from corpusflow.streaming import limits as L

START = datetime(2024, 1, 1)
LOG = "id long, user string, ts timestamp, failed boolean, size decimal(9,2), tags array<string>"


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    """Calls in seven files, each with calls up to three minutes older than what came before it, and the end marker."""
    folder = str(tmp_path_factory.mktemp("log"))
    rows = []
    for i in range(280):
        user = None if i % 11 == 0 else "hot" if i % 3 else f"u{i % 4}"
        rows.append((i, user, START + timedelta(seconds=7 * (i - i % 2), microseconds=i % 4), i % 5 != 0, Decimal(i) / 100, None if i % 2 else ["x", str(i)]))
    order = sorted(rows, key=lambda r: r[0] + 25 * (r[0] * 7919 % 2))
    for part in range(7):
        spark.createDataFrame(order[part * 40 : (part + 1) * 40], LOG).coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], LOG).schema
    L.end_marker(spark, schema, "ts", F.lit(START + timedelta(days=3))).write.mode("append").parquet(folder)
    L.prepare_state_store(spark)
    stream = lambda: spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
    return spark.createDataFrame(rows, LOG), stream


def run(stream, tmp_path):
    return C.run_to_table(stream, str(tmp_path / "out"), str(tmp_path / "cp"))


def run_out(spark, stream, folder):
    """What a stream writes, in how many batches it came out, and how much state is left."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    batches = sum(any('"action":"add"' in line for line in f.open()) for f in Path(f"{folder}/out/_spark_metadata").iterdir() if f.name.isdigit())
    return out.collect(), batches, query.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.mark.parametrize("window", [60, 7, 1])
def test_rate_limit_stream_equals_batch_in_any_order(spark, log, tmp_path, window):
    batch, stream = log
    live, _, left = run_out(spark, L.rate_limit_stream(stream(), ["user"], "ts", "id", limit=3, window_seconds=window, late="5 minutes"), tmp_path)
    want = O.first_hit_windows(batch, ["user"], "ts", "id", limit=3, window_seconds=window)
    assert sorted(map(str, live)) == sorted(map(str, want.select(*live[0].asDict()).collect())) and len(live) == 280
    assert left == 0


def test_rows_come_out_when_the_watermark_has_passed_them(spark, log, tmp_path):
    live, batches, _ = run_out(spark, L.rate_limit_stream(log[1](), ["user"], "ts", "id", late="4 minutes"), tmp_path)
    assert len(live) == 280 and batches > 3


@pytest.mark.parametrize("idle", [None, 600])
def test_streak_stream_equals_batch_in_any_order(spark, log, tmp_path, idle):
    batch, stream = log
    live, _, left = run_out(spark, L.streak_stream(stream(), ["user"], "ts", "id", F.col("failed"), late="5 minutes", idle_seconds=idle).select("id", "streak"), tmp_path)
    cut = O.with_segment(batch, O.seconds(F.col("ts")), 100)
    want = O.failure_streak(cut, ["user"], [F.col("ts"), F.col("id")], F.col("failed")).select("id", "streak")
    assert sorted(map(tuple, live)) == sorted(map(tuple, want.collect()))
    assert (left == 0) == (idle is not None)  # streaks that go on are kept unless they may be forgotten


def test_idle_streaks_are_forgotten(spark, tmp_path):
    rows = [(1, "u", 0, True), (2, "u", 10, True), (3, "u", 70, True), (4, "u", 75, True), (5, "u", 80, False)]
    df = spark.createDataFrame(rows, "id long, user string, s int, failed boolean").select("id", "user", F.timestamp_seconds(F.col("s") + 10**9).alias("ts"), "failed")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    L.end_marker(spark, df.schema, "ts", F.timestamp_seconds(F.lit(2 * 10**9))).write.mode("append").parquet(str(tmp_path / "in"))
    L.prepare_state_store(spark)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live, _, left = run_out(spark, L.streak_stream(stream, ["user"], "ts", "id", F.col("failed"), idle_seconds=60), tmp_path)
    assert sorted((r["id"], r["streak"]) for r in live) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 0)] and left == 0


def test_waiting_keys_share_their_state(spark, tmp_path):
    """Thousands of keys wait in few entries of the state store, and come out as the batch form has them."""
    n = 4_000
    key = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, F.lit(0.0) * F.when(F.col("id") % 2 == 0, -1).otherwise(1)).otherwise(F.col("id") % 3_000 + 0.5)
    hits = spark.range(n).select("id", key.alias("user"), F.timestamp_micros(F.col("id") * 1_500_000 + 10**15).alias("ts"), (F.col("id") % 3 != 0).alias("failed"))
    hits.coalesce(1).write.parquet(str(tmp_path / "in"))
    L.prepare_state_store(spark)
    stream = lambda: spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    limit = lambda: L.rate_limit_stream(stream(), ["user"], "ts", "id", limit=2, window_seconds=600, late="3 hours")
    live, _, left = run_out(spark, limit(), tmp_path / "limit")
    assert not live and 0 < left < n / 4
    L.end_marker(spark, hits.schema, "ts", F.timestamp_seconds(F.lit(2 * 10**9))).write.mode("append").parquet(str(tmp_path / "in"))
    # the stopped query goes on from its state
    live, _, left = run_out(spark, limit(), tmp_path / "limit")
    want = O.first_hit_windows(hits, ["user"], "ts", "id", limit=2, window_seconds=600).select(*live[0].asDict())
    assert sorted(map(str, live)) == sorted(map(str, want.collect())) and len(live) == n and left == 0
    live, _, _ = run_out(spark, L.streak_stream(stream(), ["user"], "ts", "id", F.col("failed"), late="3 hours").select("id", "streak"), tmp_path / "streak")
    want = O.failure_streak(O.with_segment(hits, O.seconds(F.col("ts")), 1_000), ["user"], [F.col("ts"), F.col("id")], F.col("failed")).select("id", "streak")
    assert sorted(map(tuple, live)) == sorted(map(tuple, want.collect()))


def test_clock_windows_are_complete(spark, log, tmp_path):
    batch, stream = log
    out = run(L.clock_windows(stream(), ["user"], "ts", 60, "5 minutes").select("user", "window", "hits"), tmp_path).collect()
    want = batch.groupBy("user", F.window("ts", "60 seconds").alias("window")).agg(F.count("*").alias("hits")).collect()
    assert sorted((str(r["user"]), r["window"]["start"], r["hits"]) for r in out) == sorted((str(r["user"]), r["window"]["start"], r["hits"]) for r in want)


def test_new_url_stream(spark, tmp_path):
    rows = [("http://a.org/x", 1), ("http://www.a.org/x/", 2), ("http://b.org/", 3), ("http://known.org/?utm_q=1", 4)]
    df = spark.createDataFrame(rows, "url string, n int").select("url", F.timestamp_seconds(F.col("n") + 10**9).alias("ts"))
    df.write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("http://known.org/",)], "url_key string")
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = run(C.new_url_stream(stream, known, "url", "ts").select("url_key"), tmp_path)
    assert sorted(r[0] for r in out.collect()) == ["http://a.org/x", "http://b.org/"]


def test_new_urls_come_once_however_far_apart(spark, tmp_path):
    for day in range(6):
        df = spark.createDataFrame([("http://a.org/x", 86_400 * day)], "url string, n int").select("url", F.timestamp_seconds(F.col("n") + 10**9).alias("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([], "url_key string")
    L.prepare_state_store(spark)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert [r[0] for r in run(C.new_url_stream(stream, known, "url", "ts").select("url_key"), tmp_path).collect()] == ["http://a.org/x"]


def test_single_use_and_revocation_streams(spark, tmp_path):
    rows = [("t1", "u", 10), ("t1", "u", 11), ("t2", "u", 30), ("t3", "v", 5)]
    df = spark.createDataFrame(rows, "jti string, user string, n long").withColumn("ts", F.timestamp_seconds(F.col("n") + 10**9))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    won = C.run_to_table(L.single_use_stream(stream(), "jti", "ts", "1 hour").select("jti"), str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(r[0] for r in won.collect()) == ["t1", "t2", "t3"]
    epochs = spark.createDataFrame([("u", 11), ("u", 5)], "user string, epoch long")
    out = L.revocation_stream(stream(), epochs, "user", "n").select("jti", "n", "revoked")
    got = C.run_to_table(out, str(tmp_path / "c"), str(tmp_path / "d")).collect()
    assert {(r["jti"], r["n"]): r["revoked"] for r in got} == {("t1", 10): True, ("t1", 11): False, ("t2", 30): False, ("t3", 5): False}


def page(*docs):
    """A landed HAL answer with (title, url, author) records."""
    docs = [{"title_s": [t], "uri_s": u, "authFullName_s": [a]} for t, u, a in docs]
    return ("hal", "Nok", json.dumps({"response": {"docs": docs}}))


def land(spark, folder, *pages):
    spark.createDataFrame(list(pages), C.LANDING_SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def collect(spark, folder, ledger, checkpoint):
    C.harvest_stream(C.read_landing(spark, folder), ledger, checkpoint).awaitTermination()
    return {r["url_key"]: r for r in C.ledger(spark, ledger).collect()}


def test_harvest_resumes_and_deduplicates(spark, tmp_path):
    landing, ledger, cp = (str(tmp_path / x) for x in ("landing", "ledger", "cp"))
    land(spark, landing, page(("Nok art", "https://www.a.org/1/", "Hope, Colin"), ("Nok art", "https://a.org/1", "Hope, Colin"),
                              ("Other", "https://a.org/2", "x y"), ("Nok bot", "https://a.org/3", "Claude, Anthropic")))
    first = collect(spark, landing, ledger, cp)
    assert set(first) == {"https://a.org/1"}
    row = first["https://a.org/1"]
    assert (row["title"], row["authors"], row["source"], row["subject"], row["open_source"]) == ("Nok art", "Colin Hope", "a.org", "Nok", True)
    # a restart reads only what landed since, and known addresses stay single
    land(spark, landing, page(("Nok art again", "http://a.org/1", "x y"), ("Nok iron", "https://a.org/1?utm_x=1", "x y"), ("Nok four", "https://a.org/4", "Kyle")))
    second = collect(spark, landing, ledger, cp)
    assert set(second) == {"https://a.org/1", "http://a.org/1", "https://a.org/4"}
    assert second["https://a.org/1"]["title"] == "Nok art" and second["https://a.org/4"]["authors"] == ""
    assert {r["batch_id"] for r in second.values()} == {0, 1}
    # nothing new: nothing written
    assert collect(spark, landing, ledger, cp).keys() == second.keys()


def test_redirects_are_claimed_over_batches(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    to = spark.createDataFrame([("https://a.org/1", "https://a.org/x"), ("https://a.org/2", "https://a.org/x/"), ("https://a.org/4", "https://a.org/3"),
                                ("https://a.org/5", None)], "url_key string, final_url string")
    write = C.append_batch(ledger, lambda: to)
    batch = lambda *urls: C.ledger_candidates(spark.createDataFrame([page(*[("Nok art", u, "A B") for u in urls])], C.LANDING_SCHEMA))
    write(batch("https://a.org/1"), 0)
    # a.org/x is claimed by what moved there; a.org/3 is an address of this batch
    for _ in range(2):
        write(batch("https://a.org/x", "https://a.org/2", "https://a.org/3", "https://a.org/4", "https://a.org/5"), 1)
    got = {r["url_key"]: r["hyperlink"] for r in C.ledger(spark, ledger).collect()}
    assert got == {"https://a.org/1": "https://a.org/x", "https://a.org/3": "https://a.org/3", "https://a.org/5": "https://a.org/5"}
    assert [r["url_key"] for r in C.claims_store(spark, ledger).read().collect()] == ["https://a.org/x"]


def test_walked_answers_join_the_harvest(spark, tmp_path):
    """Answers of a walked repository are labelled by the concept they mention, beside pages of a searched catalogue."""
    dc = lambda tag, text: f"<dc:{tag}>{text}</dc:{tag}>"
    record = lambda title, url: f"<record><header/><metadata><oai_dc:dc>{dc('title', title)}{dc('creator', 'Amina Diallo')}{dc('identifier', url)}</oai_dc:dc></metadata></record>"
    answer = "<OAI-PMH><ListRecords>" + record("Iron of the Nok", "https://r.org/1") + record("Weather", "https://r.org/2") + "</ListRecords></OAI-PMH>"
    concepts = spark.createDataFrame([("Nok",)], "c string")
    landing = str(tmp_path / "landing")
    land(spark, landing, page(("Nok art", "https://a.org/1", "Hope, Colin")))
    land(spark, landing, ("repo", None, answer))
    C.harvest_stream(C.read_landing(spark, landing), str(tmp_path / "ledger"), str(tmp_path / "cp"),
                     label=lambda df, text, out: concept_label(df, text, concepts, "c", out)).awaitTermination()
    got = {r["url_key"]: (r["subject"], r["authors"]) for r in C.ledger(spark, str(tmp_path / "ledger")).collect()}
    assert got == {"https://a.org/1": ("Nok", "Colin Hope"), "https://r.org/1": ("Nok", "Amina Diallo")}


def test_walks_go_on_after_a_stop_and_restart_alone(spark, tmp_path):
    """Two sources in three deliveries, the query stopped after each; an expired token sends one source back, not the other."""
    L.prepare_state_store(spark)
    schema = "source string, seq long, asked string, payload string"
    answer = lambda token: f"<OAI-PMH><ListRecords><record><header/></record><resumptionToken>{token}</resumptionToken></ListRecords></OAI-PMH>"
    error = '<OAI-PMH><error code="badResumptionToken">gone</error></OAI-PMH>'
    deliveries = [
        [("a", 2, "a1", answer("a2")), ("a", 1, None, answer("a1")), ("b", 1, None, error), ("b", 2, None, answer("b2")), (None, 1, None, error)],
        [("a", 2, "a1", answer("a2")), ("a", 3, "a2", error), ("b", 3, "b2", "<html>"), ("b", 4, "b2", answer("b4"))],
        [("a", 4, "a2", answer("x")), ("a", 5, None, answer("a5")), ("b", 5, "b4", answer("")), ("b", 6, None, answer("b6")), ("b", None, "b6", error)],
    ]
    for rows in deliveries:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "landing"))
        out = run(C.walk_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "landing"))), tmp_path)
    got = sorted((r["source"], r["seq"], r["status"], r["token"], r["payload"] is not None) for r in out.collect())
    assert got == sorted([
        ("a", 1, "taken", "a1", True), ("a", 2, "taken", "a2", True), ("a", 2, "stale", None, False), ("a", 3, "restarted", None, False),
        ("a", 4, "stale", None, False), ("a", 5, "taken", "a5", True), ("b", 1, "failed", None, False), ("b", 2, "taken", "b2", True),
        ("b", 3, "failed", "b2", False), ("b", 4, "taken", "b4", True), ("b", 5, "finished", None, True), ("b", 6, "taken", "b6", True),
    ])


def test_a_batch_is_mapped_once(spark, tmp_path):
    """The store asks for a batch's rows several times; their mapping is not run anew for it, nor for a replay."""
    mapped = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def title(n):
        mapped.add(1)
        return f"title {n}"

    write = C.append_batch(str(tmp_path / "ledger"))
    for batch_id in (0, 1, 1):
        url = F.concat(F.lit("http://a.org/"), F.col("id") + 5 * batch_id)
        rows = spark.range(20).select(url.alias("url_key"), F.lit("s").alias("subject"), F.lit("a.org").alias("source"), url.alias("hyperlink"), title("id").alias("title"),
                                      F.lit("A").alias("authors"), F.lit(True).alias("open_source"), F.lit("").alias("verdict"), F.lit(False).alias("downloaded"))
        write(rows, batch_id)
    assert C.ledger(spark, str(tmp_path / "ledger")).count() == 25 and mapped.value == 40


def test_replayed_batch_is_written_once(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    batch = C.ledger_candidates(spark.createDataFrame([page(("Nok art", "https://a.org/1", "A B"))], C.LANDING_SCHEMA))
    write = C.append_batch(ledger)
    for batch_id in (0, 0, 1):
        write(batch, batch_id)
    assert C.ledger(spark, ledger).count() == 1


def test_incremental_index(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, t string")
    new = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "k string, t string")
    add, gone = C.incremental_index(new, old, "k", "t", lambda df: df.withColumn("v", F.length("t")))
    assert sorted(r["k"] for r in add.collect()) == ["b", "d"]
    assert sorted(r["k"] for r in gone.collect()) == ["b", "c"]


def test_rows_are_let_out_by_number_or_age_exactly_once(spark, tmp_path):
    import time

    L.prepare_state_store(spark)
    landing, schema = str(tmp_path / "in"), "lane string, n long, at timestamp"
    rows = [("a" if i < 19 else None, None if i == 3 else i, START) for i in range(22)]
    for part in (rows[:5], rows[5:12], rows[12:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(landing)

    def run_until(ready):
        stream = C.flush_by_rows_or_age(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landing), F.col("lane"), most=8, age_seconds=10)
        query = (
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
        )
        until = time.time() + 60
        while query.isActive and not ready(read()) and time.time() < until:
            time.sleep(1)
        query.stop()
        if query.exception():
            raise query.exception()

    def read():
        known = (tmp_path / "out" / "_spark_metadata").exists()
        return spark.read.schema(f"{schema}, flushed string").parquet(str(tmp_path / "out")).collect() if known else []

    run_until(lambda out: sum(r["flushed"] == "rows" for r in out) >= 8)
    run_until(lambda out: len(out) >= 22)
    out = read()
    assert sorted(((r["lane"], r["n"], r["at"]) for r in out), key=str) == sorted(rows, key=str)
    by_rows = sum(r["flushed"] == "rows" for r in out)
    assert by_rows >= 8 and by_rows % 8 == 0 and all(r["lane"] == "a" for r in out if r["flushed"] == "rows")
    with pytest.raises(ValueError):
        C.harvest_stream(C.read_landing(spark, landing), str(tmp_path / "l"), str(tmp_path / "c"), buffered=True)


def test_publish_runs_embed_only_what_changed(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "index"), "k", "k string, digest string, v int, run int", buckets=4)
    seen = []

    def embed(df):
        seen.append(sorted(r["k"] for r in df.select("k").collect()))
        return df.withColumn("v", F.when(F.col("t") != "bad", F.length("t")))

    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, t string")
    first = frame(("a", "1"), ("b", "22"), ("c", "bad"), ("d", "4"), (None, "x"), ("e", None))
    second = frame(("a", "1"), ("b", "333"), ("c", "55"), ("f", ""))
    assert C.publish_run(first, store, "t", embed, "v", 1) == {"scanned": 5, "indexed": 3, "failed": 2, "deleted": 0}
    assert C.publish_run(second, store, "t", embed, "v", 2) == {"scanned": 4, "indexed": 3, "failed": 0, "deleted": 1}
    assert seen == [["a", "b", "c", "d", "e"], ["b", "c", "f"]]
    want = [("a", 1, 1), ("b", 3, 2), ("c", 2, 2), ("f", 0, 2)]
    assert sorted((r["k"], r["v"], r["run"]) for r in store.read().collect()) == want
    assert C.publish_run(second, store, "t", embed, "v", 3) == {"scanned": 4, "indexed": 0, "failed": 0, "deleted": 0}
    assert C.publish_run(first.where("false"), store, "t", embed, "v", 4)["deleted"] == 4 and store.read().count() == 0


def test_loose_catalogues_are_checked_again(spark):
    import json

    record = lambda title: json.dumps({"results": [{"display_name": title, "best_oa_location": {"pdf_url": None, "landing_page_url": "https://x.org/1"}, "authorships": []}]})
    pages = spark.createDataFrame([("openalex", "kingdom of kush", record(t)) for t in ("A history of the Kingdom of Kush", "Cooking with rice and beans")], C.LANDING_SCHEMA)
    kept = [r["title"] for r in C.ledger_candidates(pages, strict=False).collect()]
    assert kept == ["A history of the Kingdom of Kush"]
