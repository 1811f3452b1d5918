"""Lookups, ownership, attribution and deduplication against what is known."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions.arrow import fold
from corpusflow.functions.names import first_author, name_in_text
from corpusflow.functions.titles import unwrap_full_text_title
from corpusflow.functions.urls import normalise_url
from corpusflow.operators.windows import first_wins


def new_urls(candidates: DataFrame, ledger: DataFrame, order: Sequence[Column], url: str = "url",
             ledger_url: str = "hyperlink") -> DataFrame:
    """Candidates whose address is not in the ledger, first of each address."""
    keyed = candidates.withColumn("url_key", normalise_url(url))
    known = ledger.select(normalise_url(ledger_url).alias("url_key")).distinct()
    return first_wins(keyed, ["url_key"], order).join(known, "url_key", "left_anti")


def claim_redirects(probed: DataFrame, ledger_keys: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Keep probed rows whose final address is theirs or still unclaimed.

    ``probed(url_key, final_url, …)`` holds one row per claimed ``url_key``. A
    row that was redirected must find its final address unclaimed by the
    ledger, by another row's own address and by an earlier redirect. A row
    without a final address stayed where it was.
    """
    rows = probed.withColumn("final_key", F.coalesce(normalise_url("final_url"), F.col("url_key")))
    stayed = rows.where("final_key = url_key")
    claimed = ledger_keys.select("url_key").unionByName(probed.select("url_key")).distinct()
    moved = rows.where("final_key <> url_key").join(
        claimed.withColumnRenamed("url_key", "final_key"), "final_key", "left_anti"
    )
    return stayed.unionByName(first_wins(moved, ["final_key"], order).select(*stayed.columns))


def author_ladder(docs: DataFrame, evidence: DataFrame, rungs: Sequence[str], key: str = "key", title: str = "title",
                  text: str | None = None, printed_only: Sequence[str] = ("pdf-metadata",)) -> DataFrame:
    """Credit each document with the first rung that names authors.

    ``evidence(key, method, authors)`` holds what the rungs found; ``rungs``
    orders the methods. Methods ending in ``:title`` come from a title search:
    with document text at hand only names printed in it count, without text the
    title must have seven words. Of the methods in ``printed_only`` names count
    only if the document's text prints them.
    """
    order = F.array_position(F.array(*[F.lit(r) for r in rungs]), F.col("method"))
    rows = evidence.withColumn("_rung", order).where("_rung > 0 AND size(authors) > 0")
    plain = unwrap_full_text_title(F.col(title))
    words = F.size(F.regexp_extract_all(plain, F.lit(r"(?U)(\w+)"), F.lit(1)))
    known = docs.withColumn("_words", words)
    direct = rows.where(~F.col("method").endswith(":title"))
    searched = rows.where(F.col("method").endswith(":title"))
    # only what no direct rung answered is worth the text comparison
    open_ = searched.join(direct.select(key).distinct(), key, "left_anti")
    own = direct.where(F.col("method").isin(*printed_only))
    direct = direct.where(~F.col("method").isin(*printed_only))
    cols = [key, "_words"] + ([text] if text else [])
    checked = open_.join(known.select(*cols), key)
    if text:
        checked = checked.withColumn("_folded", fold(F.coalesce(F.col(text), F.lit(""))))
        printed = F.filter("authors", lambda n: name_in_text(n, F.col("_folded")))
        has_text = F.col("_folded") != ""
    else:
        printed, has_text = F.array().cast("array<string>"), F.lit(False)
    enough = F.col("_words") >= rules.TITLE_MIN_WORDS_UNCORROBORATED
    confirmed = checked.where(F.col("_words") >= rules.TITLE_MIN_WORDS).withColumn(
        "authors",
        F.when(has_text, printed).when(enough, F.col("authors")).otherwise(F.array().cast("array<string>")),
    ).where("size(authors) > 0").select(*rows.columns)
    if text:
        seen = own.join(known.select(key, text), key).withColumn("_folded", fold(F.coalesce(F.col(text), F.lit(""))))
        named = F.filter("authors", lambda n: name_in_text(n, F.col("_folded")))
        printed_own = seen.withColumn("authors", named).where("size(authors) > 0").select(*rows.columns)
        direct = direct.unionByName(printed_own)
    best = (
        direct.unionByName(confirmed)
        .groupBy(key)
        .agg(F.min_by(F.struct("method", "authors"), "_rung").alias("_best"))
    )
    return docs.join(best, key, "left").select(
        *docs.columns, F.col("_best.method").alias("method"), F.col("_best.authors").alias("authors")
    )


def label_cache(rows: DataFrame, cache: DataFrame, key: str = "label_key", verdict: str = "verdict") -> DataFrame:
    """Reuse one verdict per key on every row; adds ``label_state``.

    A key the cache lacks is ``unseen``, one judged without result ``unsure``.
    """
    known = cache.select(key, F.col(verdict).alias("verdict"), F.lit(True).alias("_known"))
    joined = rows.join(known, key, "left")
    state = F.when(F.col("_known").isNull(), "unseen").when(F.col("verdict").isNull(), "unsure").otherwise("labelled")
    return joined.withColumn("label_state", state).drop("_known")


def unjudged_keys(rows: DataFrame, cache: DataFrame, authors: str = "authors", key: str = "label_key") -> DataFrame:
    """Distinct keys still to be judged: one question per author, not per row."""
    wanted = rows.select(F.lower(first_author(authors)).alias(key)).where(f"{key} <> ''").distinct()
    return wanted.join(cache.select(key), key, "left_anti")


def ownership(requests: DataFrame, owned: DataFrame, on: str, caller: str, owner: str,
              usable: Column | None = None) -> DataFrame:
    """Adds ``access``: 404 unknown or not of the wanted kind, 403 somebody
    else's, else ok."""
    o = owned.select(F.col(on), F.col(owner).alias("_owner"), (usable if usable is not None else F.lit(True)).alias("_ok"))
    access = (
        F.when(F.col("_owner").isNull() | ~F.col("_ok"), "404").when(F.col("_owner") != F.col(caller), "403").otherwise("ok")
    )
    return requests.join(o, on, "left").withColumn("access", access).drop("_owner", "_ok")


def bind_attachments(messages: DataFrame, attachments: DataFrame, most: int = rules.UPLOAD_MAX_PER_MESSAGE,
                     order: Column | None = None) -> DataFrame:
    """Resolve ``messages(message_id, user_id, session_id, ids)``: one row per
    distinct attachment with ``outcome`` bind, ok, 403, 404, 409 or 422.

    An attachment without a session is bound by the first message of its owner
    that may name it (``order``, by default the message id); after that the
    session of that message is the attachment's.
    """
    order = F.col("message_id") if order is None else order
    wanted = messages.select(
        "message_id", "user_id", "session_id", order.alias("_order"), (F.size("ids") > most).alias("_too_many"),
        F.posexplode(F.array_distinct("ids")).alias("position", "attachment_id"),
    )
    a = attachments.select("attachment_id", F.col("user_id").alias("_owner"), F.col("session_id").alias("_session"))
    joined = wanted.join(a, "attachment_id", "left")
    binds = F.col("_session").isNull() & ~F.col("_too_many") & (F.col("_owner") == F.col("user_id"))
    # an aggregate, so that an attachment that many messages name is folded before it is shuffled
    first = joined.where(binds).groupBy("attachment_id").agg(
        F.min(F.struct("_order", "message_id", "session_id")).alias("_first")
    )
    session = F.coalesce("_session", "_first.session_id")
    outcome = (
        F.when(F.col("_too_many"), "422")
        .when(F.col("_owner").isNull(), "404")
        .when(F.col("_owner") != F.col("user_id"), "403")
        .when(F.col("_session").isNull() & (F.col("_first.message_id") == F.col("message_id")), "bind")
        .when(session == F.col("session_id"), "ok")
        .otherwise("409")
    )
    resolved = joined.join(first, "attachment_id", "left").withColumn("outcome", outcome)
    return resolved.drop("_too_many", "_owner", "_session", "_order", "_first")


def owner_backfill(children: DataFrame, parents: DataFrame, on: str, owner: str) -> DataFrame:
    """Copy the parent's owner to children that have none."""
    p = parents.select(on, F.col(owner).alias("_owner"))
    return children.join(p, on, "left").withColumn(owner, F.coalesce(owner, "_owner")).drop("_owner")


def orphans(uploads: DataFrame, bound: DataFrame, on: str = "attachment_id") -> DataFrame:
    """Uploads no message ever used."""
    return uploads.join(bound.select(on).distinct(), on, "left_anti")


def dealt_join(large: DataFrame, small: DataFrame, on: Sequence[str], rows_per_task: int = 1_000_000) -> DataFrame:
    """Inner join on a handful of keys: rows of the large side are dealt over as many salts as its commonest key
    needs, and the small side is copied to each of them. One aggregate finds that key's count; one number comes back.
    Rows are dealt by a digest of all their columns, so only rows that are equal throughout stay together."""
    most = large.groupBy(*on).count().agg(F.max("count")).first()[0] or 0
    salts = -(-most // rows_per_task)
    if salts <= 1:
        return large.join(small, list(on))
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in large.columns]), F.lit(salts))
    copied = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return large.withColumn("_salt", salt).join(copied, [*on, "_salt"]).drop("_salt")


def round_robin(turns: DataFrame, order: DataFrame, turn: str, group: str, rows_per_task: int = 1_000_000) -> DataFrame:
    """Give turn ``t`` the participant ``t mod n`` of its group.

    ``order(group, slot, participant)`` lists participants from slot 0. A group with many turns is dealt over tasks.
    """
    sizes = order.groupBy(group).agg(F.count("*").alias("_n"))
    slotted = dealt_join(turns, sizes, [group], rows_per_task).withColumn("slot", F.pmod(F.col(turn), F.col("_n")).cast("int"))
    return dealt_join(slotted.drop("_n"), order, [group, "slot"], rows_per_task)
