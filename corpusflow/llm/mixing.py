"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Each source is a queue of its shuffled documents, ``passes`` times over. A document's virtual finish time is
its source's cumulative words up to it, divided by the source's target: a source with twice the target
moves twice as fast, and all reach their targets at time 1. The documents of all sources in order of finish
time, cut at the total budget, are the mix.

Cumulative sums don't put a source, or the whole mix, in one task: rows are sorted into ranges, written, summed by range, and
each range starts from the sum of those before it. Targets come from aggregates over the sources, one a round
of resharing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"


def in_ranges(df: DataFrame, order: list[Column], purpose: str) -> DataFrame:
    """The rows with ``part``, written in ranges of the order."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(width, *order).withColumn("part", F.spark_partition_id()), purpose)


def running(df: DataFrame, value: str, order: list[Column], keys: list[str], name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows before each, in ``order``, among rows with equal ``keys`` (which the order begins with).

    ``df`` is of ``in_ranges``; a task sorts one range, and sums of ranges, a row for each key in a range, tell where it starts.
    """
    sums = df.groupBy(*keys, "part").agg(F.sum(value).alias("own"))
    before = F.sum("own").over(Window.partitionBy(*keys).orderBy("part")) - F.col("own")
    bases = sums.select(*[F.col(k).alias(f"base_{k}") for k in keys], F.col("part").alias("base_part"), before.alias("base"))
    within = F.sum(value).over(Window.partitionBy("part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    same = F.col("part") == F.col("base_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"base_{k}"))
    return df.withColumn("within", within).join(bases, same).withColumn(name, F.col("base") + F.col("within")).drop("base", "base_part", "within", *[f"base_{k}" for k in keys])


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int) -> DataFrame:
    """Add ``target`` to ``source, source_size``, a row for each source.

    Sources by code point, null last, take the ``weights`` in turn. They share ``share`` (a fraction) of all words
    by weight; none gets more than ``most`` times its size, and what it can't take is shared again by weight until none is above.
    """
    order = [F.col("source").asc_nulls_last()]
    spread = in_ranges(sizes.withColumn("one", F.lit(1).cast("long")), order, "sources")
    placed = running(spread.withColumn("all", F.lit(0)), "one", order, ["all"], "place")
    turn = F.array(*map(F.lit, weights))
    weighed = placed.withColumn("weight", F.get(turn, F.pmod("place", F.lit(len(weights))).cast("int")).cast("long")).select("source", "source_size", "weight")
    weighed = materialise(weighed, "weights")

    wide = lambda c: F.col(c).cast("decimal(38,0)")
    # words a unit of weight: level / below, exactly; a source is full where weight * level / below >= most * size
    level, below = 0, 1
    while True:
        full = wide("weight") * F.lit(level).cast("decimal(38,0)") >= wide("source_size") * F.lit(most * below).cast("decimal(38,0)")
        got = weighed.agg(F.sum("source_size"), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not got[2]:  # none, or all are full
            break
        up, down = share[0] * got[0] - share[1] * most * (got[1] or 0), share[1] * got[2]
        if up * below <= level * down:
            break
        level, below = up, down
    fair = (F.col("weight") * F.lit(level)).cast("double") / F.lit(float(below))
    return weighed.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise(fair))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), passes: int = 2, seed: str = "") -> DataFrame:
    """``doc_id, size, source_size, target, taken``: the words that the mix takes of each document, repeats counted.

    A document's size is its number of words (null text: 0). The mix has ``share`` of all words, rounded down;
    the document at its end is cut. No document is taken more than ``passes`` times. The shuffle is by
    the digest of ``seed`` and doc_id, so reruns agree; rows with equal doc_id stand by size, and null ids are
    shuffled by the digest of the seed. Every row is a document, repeated ones too; other columns aren't
    read, an empty table gives none.
    """
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ).withColumns({"draw": digest, "tie": F.monotonically_increasing_id()})
    queue = [F.col("source").asc_nulls_last(), F.col("draw"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    plain = materialise(plain, "words")  # texts are read once, though ranges are sampled first
    sized = in_ranges(plain, [*queue, F.col("tie")], "sizes").drop("tie").withColumn("row", F.monotonically_increasing_id())
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sizes, weights, share, passes), "targets").withColumnRenamed("source", "of")

    queued = running(sized, "size", queue, ["source"], "before").drop("part")
    queued = queued.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    times = F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass")
    finish = F.coalesce((F.col("pass") * F.col("source_size") + F.col("before") + F.col("size")).cast("double") / F.nullif(F.col("target"), F.lit(0.0)), F.lit(0.0))
    turns = queued.select("*", times).withColumn("finish", finish)
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("pass"), F.col("draw"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    merged = in_ranges(turns, [*order, F.col("row")], "queue")
    budget = share[0] * (sizes.agg(F.sum("source_size")).first()[0] or 0) // share[1]
    placed = running(merged.withColumn("all", F.lit(0)), "size", order, ["all"], "ahead")
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - F.col("ahead")))
    return placed.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum(taken).cast("long").alias("taken")).drop("row")
