"""Streams that feed the ledger and the index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow import rules
from corpusflow.functions.names import clean_name, format_authors, is_plausible_creator
from corpusflow.functions.text import is_relevant, phrase_in_text
from corpusflow.functions.titles import clean_title
from corpusflow.functions.urls import is_open_access, normalise_url, source_domain
from corpusflow.operators.joins import claim_redirects
from corpusflow.operators.windows import first_wins
from corpusflow.session import materialise
from corpusflow.sources.catalogues import MAPPERS, harvest, oai_outcome, oai_pmh, strict_filter
from corpusflow.sources.corpus import snapshot_diff
from corpusflow.sources.ledger import validate_rows
from corpusflow.sources.store import KeyedStore

LANDING_SCHEMA = "source string, concept string, payload string"
LEDGER_SCHEMA = (
    "url_key string, subject string, source string, hyperlink string, title string, authors string, "
    "open_source boolean, verdict string, downloaded boolean, batch_id long"
)


def read_landing(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """Landed catalogue pages as a stream; the checkpoint is the source cursor."""
    return (
        spark.readStream.schema(LANDING_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def new_url_stream(hits: DataFrame, ledger_keys: DataFrame, url: str, ts: str, horizon: str | None = None) -> DataFrame:
    """First hit of every address that the ledger lacks, however far apart its hits are.

    The addresses seen are keyed state; it grows with them and is spread over the state store's partitions. With a
    ``horizon`` they are forgotten once the watermark has passed it, for a sink that drops known addresses itself.
    """
    keyed = hits.withColumn("url_key", normalise_url(url))
    known = ledger_keys.select("url_key").distinct()
    if horizon is None:
        return keyed.join(known, "url_key", "left_anti").dropDuplicates(["url_key"])
    return keyed.withWatermark(ts, horizon).join(known, "url_key", "left_anti").dropDuplicatesWithinWatermark(["url_key"])


def ledger_candidates(pages: DataFrame, strict: bool = True, label: Callable[[DataFrame, str, str], DataFrame] | None = None) -> DataFrame:
    """Landed pages -> valid ledger rows keyed by canonical address.

    With ``label(df, text, out)``, pages of sources that are no searched catalogue are answers of walked repositories.

    Records of catalogues that rank by relevance can drift off topic, so their
    title must carry the concept, or title and address most of its words.
    """
    records = harvest(pages)
    if label is not None:
        records = records.unionByName(oai_pmh(pages.where(~F.col("source").isin(*MAPPERS)), label))
    records = strict_filter(records, strict).withColumns(
        {"url_key": normalise_url("url"), "clean": clean_title("title", "url")}
    )
    on_topic = phrase_in_text("concept", "clean") | is_relevant("concept", F.col("clean"), F.col("url"))
    records = records.where(~F.col("needs_check") | on_topic)
    names = F.filter(F.transform("authors", clean_name), is_plausible_creator)
    rows = records.select(
        "url_key",
        F.col("concept").alias("subject"),
        source_domain("url").alias("source"),
        F.col("url").alias("hyperlink"),
        F.col("clean").alias("title"),
        format_authors(names).alias("authors"),
        is_open_access("url").alias("open_source"),
        F.lit("").alias("verdict"),
        F.lit(False).alias("downloaded"),
    )
    return validate_rows(rows).where("reject_reason IS NULL").drop("reject_reason")


def ledger_store(spark: SparkSession, path: str) -> KeyedStore:
    """The ledger, a store in buckets of the canonical address."""
    return KeyedStore(spark, path, "url_key", LEDGER_SCHEMA)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger written so far (empty before the first batch)."""
    return ledger_store(spark, path).read()


def claims_store(spark: SparkSession, path: str) -> KeyedStore:
    """Final addresses that rows of the ledger were redirected to, beside the ledger at ``path``."""
    return KeyedStore(spark, f"{path.rstrip('/')}-claims", "url_key", "url_key string")


def append_batch(path: str, redirects: Callable[[], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer: only rows the ledger lacks, as new parts of the buckets they fall into.

    ``redirects()`` gives the probed addresses ``(url_key, final_url)`` known by now, one row each. A row that was redirected must find its
    final address unclaimed by rows of this and of all earlier batches, and its hyperlink is that address; a row
    whose own address an earlier one was redirected to stays out. A batch that is replayed after a failure finds
    its number written and adds nothing; claims are taken from what was written, so they are made good then.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = ledger_store(spark, path)
        order = [F.col("hyperlink"), F.col("title"), F.col("subject")]
        last = store.last_commit()
        if last is None or last < batch_id:
            # mapped once, though the store looks at the rows several times
            fresh = materialise(first_wins(batch, ["url_key"], order).withColumn("batch_id", F.lit(batch_id).cast("long")), "batch")
        if redirects is None:
            if last is None or last < batch_id:
                store.add(fresh, commit=batch_id)
            return
        claims = claims_store(spark, path)
        if last is None or last < batch_id:
            probed = fresh.join(redirects().select("url_key", "final_url"), "url_key", "left")
            probed = materialise(claims.missing(store.missing(probed)), "probed")
            finals = probed.select(normalise_url("final_url").alias("url_key")).where("url_key IS NOT NULL").distinct()
            finals = materialise(finals, "finals")
            known = finals.join(claims.missing(store.missing(finals)), "url_key", "left_anti")
            kept = claim_redirects(probed, known, [F.col("url_key")])
            moved = F.col("final_key") != F.col("url_key")
            store.add(kept.withColumn("hyperlink", F.when(moved, F.col("final_url")).otherwise(F.col("hyperlink"))), commit=batch_id)
        added = store.written(batch_id).where(F.col("batch_id") == batch_id)
        final = normalise_url("hyperlink")
        claims.add(added.where(final != F.col("url_key")).select(final.alias("url_key")), commit=batch_id)

    return write


_ROW_FORMAT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class _Buffer(StatefulProcessor):
    """Rows of a lane wait until there are enough of them or the oldest has waited long enough."""

    def __init__(self, most: int, millis: int):
        self.most, self.millis = most, millis

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "row string")

    def _out(self, key, rows: list, why: str) -> pd.DataFrame:
        return pd.DataFrame({"lane": [key[0]] * len(rows), "row": rows, "flushed": [why] * len(rows)})

    def _forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        waiting = len(held)
        for frame in rows:
            held.extend(frame["row"])
            full = len(held) - len(held) % self.most
            if full:
                yield self._out(key, held[:full], "rows")
                held, waiting = held[full:], 0
        if not held:
            self._forget_timers()
            self.held.clear()
            return
        self.held.put([(r,) for r in held])
        if not waiting:  # the oldest row of what waits now is new
            self._forget_timers()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [r[0] for r in self.held.get()] if self.held.exists() else []
        self.held.clear()
        if held:
            yield self._out(key, held, "age")

    def close(self) -> None:
        pass


def flush_by_rows_or_age(rows: DataFrame, lane: Column, most: int = rules.LEDGER_BATCH_ROWS, age_seconds: float = rules.LEDGER_BATCH_AGE_SECONDS) -> DataFrame:
    """A stream's rows, let out of each ``lane`` as soon as ``most`` wait there or the oldest has waited ``age_seconds``.

    What waits is keyed state, at most ``most`` rows a lane, so a restart neither loses nor repeats a row. Ages are
    processing time, for a query with a processing-time trigger; ``availableNow`` would wait for timers for ever. Adds ``flushed``: ``rows`` or ``age``.
    """
    packed = rows.select(lane.cast("string").alias("lane"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), _ROW_FORMAT).alias("row"))
    out = packed.groupBy("lane").transformWithStateInPandas(
        statefulProcessor=_Buffer(most, int(age_seconds * 1000)), outputStructType="lane string, row string, flushed string",
        outputMode="append", timeMode="ProcessingTime",
    )
    return out.select(F.from_json("row", rows.schema, _ROW_FORMAT).alias("r"), "flushed").select("r.*", "flushed")


def harvest_stream(pages: DataFrame, path: str, checkpoint: str, strict: bool = True, once: bool = True,
                   every: str = rules.LEDGER_BATCH_AGE, buffered: bool = False,
                   label: Callable[[DataFrame, str, str], DataFrame] | None = None, redirects: Callable[[], DataFrame] | None = None):
    """Landed pages -> mappers -> filters -> ledger, as one streaming query.

    ``label`` takes answers of walked repositories in too (``ledger_candidates``); a batch is labelled as a whole. ``redirects`` are
    claimed as by ``append_batch``.

    ``buffered`` rows of a source reach the ledger eight at a time, or when the oldest of them is ten minutes old; that
    needs a query that stays (``once=False``) and a short ``every``.
    """
    write = append_batch(path, redirects)
    if label is not None:
        if buffered:
            raise ValueError("walked answers are labelled by batch: buffered goes without label")
        rows, into = pages, lambda batch, number: write(ledger_candidates(batch, strict, label), number)
    else:
        rows, into = ledger_candidates(pages, strict), write
    if buffered:
        if once:
            raise ValueError("ages pass only in a query that stays: buffered needs once=False")
        rows = flush_by_rows_or_age(rows, F.col("source")).drop("flushed")
    writer = rows.writeStream.foreachBatch(into).option(
        "checkpointLocation", checkpoint
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


WALK = "source string, seq long, status string, token string, payload string"


class _Cursor(StatefulProcessor):
    """Where the walk through one source goes on."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the number of the last answer seen, and the token to go on with ('': from the start)
        self.cursor = handle.getValueState("cursor", "seq long, token string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, token = self.cursor.get() if self.cursor.exists() else (None, "")
        # a walk has one answer after another, so a batch holds few of a source, however many it has in all
        answers = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for seq, asked, offered, reason, payload in answers[["seq", "asked", "offered", "reason", "payload"]].itertuples(index=False):
            if (last is not None and seq <= last) or asked != token:
                out.append((key[0], seq, "stale", None, None))
                continue
            last = seq
            if reason == "unreadable" or (reason.startswith("error") and not token):
                out.append((key[0], seq, "failed", token or None, None))
            elif reason.startswith("error"):
                token = ""
                out.append((key[0], seq, "restarted", None, None))
            else:
                token = offered
                out.append((key[0], seq, "taken" if token else "finished", token or None, payload))
        if last is not None:
            self.cursor.update((int(last), token))
        yield pd.DataFrame(out, columns=["source", "seq", "status", "token", "payload"])

    def close(self) -> None:
        pass


def walk_stream(answers: DataFrame) -> DataFrame:
    """Landed answers ``(source, seq, asked, payload)`` of walked repositories -> ``(source, seq, status, token, payload)``.

    The cursor of a source is keyed state: the token its walk goes on with. An answer counts if it is newer than the last
    one and answers that token (``asked``, null for a walk from the start); others are ``stale``, as after a delivery that comes
    twice. One that counts is ``taken``, ``finished`` (no further token: the next walk starts anew), ``restarted`` (an error to a
    token: this source alone begins again) or ``failed`` (unreadable, or an error at the start: asked again). Only answers
    that are taken or finish a walk keep their payload, for ``oai_pmh``. A restarted query goes on where each source stopped.
    Answers without source or number are left out.
    """
    read = oai_outcome(answers.where("source IS NOT NULL AND seq IS NOT NULL"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = read.withColumnRenamed("token", "offered").select("source", F.col("seq").cast("long").alias("seq"), blank("asked"), blank("offered"), blank("reason"), "payload")
    return rows.groupBy("source").transformWithStateInPandas(statefulProcessor=_Cursor(), outputStructType=WALK, outputMode="append", timeMode="None")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run a stream over everything available, then read what it wrote."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def incremental_index(new: DataFrame, old: DataFrame, key: str, content: str,
                      embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What the hourly publish run has to index: (rows to add, keys to remove).

    Unchanged documents are never embedded again.
    """
    status = snapshot_diff(old, new, key, content)
    todo = new.join(status.where("status IN ('new', 'changed')").select(key), key, "left_semi")
    gone = status.where("status IN ('deleted', 'changed')").select(key)
    return embed(todo), gone


def publish_run(documents: DataFrame, store: KeyedStore, content: str, embed: Callable[[DataFrame], DataFrame],
                value: str, run: int) -> dict[str, int]:
    """One run of the hourly publish: the store becomes the index of this snapshot of documents.

    Only new and changed documents are embedded; deleted ones go, and only buckets with either are written. A
    document whose ``value`` comes out null has failed: it isn't in the index, and the next run tries it again. The
    store's rows carry the content's ``digest`` and the ``run`` that indexed them. Rows without a key are
    left out. Returns the counts scanned, indexed, failed and deleted; a run that is repeated finds nothing to do.
    """
    key = store.key
    digest = F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256)
    scanned = documents.where(F.col(key).isNotNull()).withColumn("digest", digest)
    todo, gone = incremental_index(scanned, store.read().select(key, "digest"), key, "digest", embed)
    tried = materialise(todo.withColumn("run", F.lit(run)), "embedded")
    gone = materialise(gone, "gone")
    arrived = tried.where(F.col(value).isNotNull()).select(*store.schema.names)

    def merge(stored: DataFrame, delivery: DataFrame) -> DataFrame:
        kept = stored.join(delivery.select(key), key, "left_anti")
        return kept.unionByName(delivery.where("NOT _gone").drop("_gone"))

    delivery = arrived.withColumn("_gone", F.lit(False)).unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
    store.upsert(delivery, merge, commit=run)
    counts = tried.agg(F.count(value).alias("indexed"), F.count_if(F.col(value).isNull()).alias("failed")).first()
    deleted = gone.join(tried.select(key), key, "left_anti").count()
    return {"scanned": scanned.count(), "indexed": counts["indexed"], "failed": counts["failed"], "deleted": deleted}
