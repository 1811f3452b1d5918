"""Ranked, positional and as-of results per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.operators.ordered import SEGMENT, following, running, seconds, with_segment

#: Order of roles that share a time stamp.
ROLE_ORDER = ("system", "user", "assistant", "tool")


def role_ordinal(role: Column) -> Column:
    return F.array_position(F.array(*[F.lit(r) for r in ROLE_ORDER]), role).cast("int")


def last_messages(
    df: DataFrame, session: str, created: str, role: str = "role", keep: int = rules.HISTORY_MESSAGES,
    roles: Sequence[str] = ("user", "assistant"),
) -> DataFrame:
    """Newest ``keep`` chat messages per session, numbered oldest first.

    The rank filter becomes a per-partition limit ahead of the shuffle, so a
    long session ships ``keep`` rows per partition, not all of them.
    """
    newest = Window.partitionBy(session).orderBy(F.desc(created), F.desc(role_ordinal(F.col(role))))
    kept = df.where(F.col(role).isin(*roles)).withColumn("_rank", F.row_number().over(newest)).where(f"_rank <= {keep}")
    count = F.count("*").over(Window.partitionBy(session))
    return kept.withColumn("position", (count - F.col("_rank")).cast("int")).drop("_rank")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], segment: Column, width: float,
              out: str = "position") -> DataFrame:
    """0-based position of every row in its key, hot keys included."""
    numbered = running(with_segment(df, segment, width), keys, order, F.lit(1), out)
    return numbered.withColumn(out, (F.col(out) - 1).cast("int")).drop(SEGMENT)


def transcript(df: DataFrame, session: str, created: str, role: str = "role", width: float = 10_000) -> DataFrame:
    """All messages of each session numbered in reading order."""
    return positions(df, [session], [F.col(created), role_ordinal(F.col(role))], F.col(created), width)


def rolling_context(
    df: DataFrame, session: str, order: str, text: str, previous: int = 6, width: int = 10_000,
    out: str = "context",
) -> DataFrame:
    """The previous few turns joined by new lines.

    Rows are cut into blocks by position; the last rows of a block are copied
    to the next one as lead-in, so a block needs nothing else.
    """
    numbered = positions(df, [session], [F.col(order)], F.col(order), width, "_pos")
    block, offset = F.floor(F.col("_pos") / width), F.col("_pos") % width
    home = F.struct(block.alias("block"), F.lit(False).alias("lead_in"))
    ahead = F.struct((block + 1).alias("block"), F.lit(True).alias("lead_in"))
    copies = F.when(offset >= width - previous, F.array(home, ahead)).otherwise(F.array(home))
    spread = numbered.withColumn("_b", F.explode(copies)).withColumns(
        {"_block": F.col("_b.block"), "_lead_in": F.col("_b.lead_in")}
    )
    w = Window.partitionBy(session, "_block").orderBy("_pos").rowsBetween(-previous, -1)
    return (
        spread.withColumn(out, F.array_join(F.collect_list(text).over(w), "\n"))
        .where("NOT _lead_in")
        .drop("_pos", "_b", "_block", "_lead_in")
    )


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first in order. An aggregate, so copies are folded
    before the shuffle."""
    row = F.struct(*[c for c in df.columns if c not in key])
    return df.groupBy(*key).agg(F.min_by(row, F.struct(*order)).alias("_row")).select(*key, "_row.*")


def best_file(files: DataFrame, item: str, url_path: Column, name: str = "name", source: str = "source",
              size: str = "size") -> DataFrame:
    """Per item: the file its address names, else the original, else the largest."""
    rank = [
        (~F.contains(url_path, F.col(name))).cast("int"),
        F.when(F.col(source) == "original", 0).otherwise(1),
        -F.coalesce(F.col(size), F.lit(0)),
        F.col(name),
    ]
    return first_wins(files, [item], rank)


def best_text_file(files: DataFrame, item: str, url_path: Column, position: str, name: str = "name",
                   suffix: str = "_djvu.txt") -> DataFrame:
    """Per item: the OCR text the address names, else the first listed."""
    texts = files.where(F.col(name).endswith(suffix))
    wanted = F.replace(url_path, F.lit("+"), F.lit(" "))
    return first_wins(texts, [item], [(~F.contains(wanted, F.col(name))).cast("int"), F.col(position)])


def token_validity(
    tokens: DataFrame, keys: Sequence[str], issued: str, consumed: str, ttl_seconds: int, tie: str,
    segment_seconds: int = 86_400,
) -> DataFrame:
    """Only the latest token per purpose and user lives: each ends at the next
    issue, its time to live or its use, whichever comes first."""
    cut = with_segment(tokens, seconds(F.col(issued)), segment_seconds)
    nxt = following(cut, keys, [F.col(issued), F.col(tie)], issued, "_next_issue")
    expiry = F.col(issued) + F.make_dt_interval(secs=F.lit(ttl_seconds))
    end = F.least(F.col("_next_issue"), expiry, F.col(consumed))
    reason = (
        F.when(end == F.col(consumed), "consumed").when(end == F.col("_next_issue"), "superseded").otherwise("expired")
    )
    return nxt.withColumns({"valid_until": end, "ended_by": reason}).drop("_next_issue", SEGMENT)


def session_epochs(
    events: DataFrame, user: str, ts: str, tie: str, is_epoch: Column, issued_at: Column, segment_seconds: int = 86_400
) -> DataFrame:
    """Token uses with the user's latest epoch at that moment; a token issued
    before it, in whole seconds, is revoked."""
    cut = with_segment(events, seconds(F.col(ts)), segment_seconds)
    cut = cut.withColumn("_epoch_here", F.coalesce(is_epoch, F.lit(False)))
    seen = running(
        cut, [user], [F.col(ts), F.col(tie)], F.when(F.col("_epoch_here"), F.col(ts)), "epoch", how="max"
    )
    uses = seen.where(~F.col("_epoch_here")).withColumn("issued_at", issued_at)
    return uses.withColumn(
        "revoked", F.coalesce(F.date_trunc("second", "issued_at") < F.date_trunc("second", "epoch"), F.lit(False))
    ).drop("_epoch_here", SEGMENT)


def single_use(claims: DataFrame, token: str, order: Sequence[Column]) -> DataFrame:
    """Exactly one winning claim per token, the earliest."""
    return first_wins(claims, [token], order)
