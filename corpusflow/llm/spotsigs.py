"""Document fingerprints from spot signatures, in DataFrame functions alone.

A common word is an anchor; its signature is the anchor and the chain of content words that follow it. Prose has many,
navigation and boilerplate few. A document's fingerprint is the set of its signatures' digests. Two are compared by
Jaccard similarity. Sizes alone bound it by the smaller over the larger, so sets are partitioned by
length: with a threshold, only sets of one partition or of neighbouring ones can be similar.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.basic import let
from corpusflow.llm.common import id_and_text

#: Common words of English, French, German and Spanish. A parameter of every function here.
ANCHORS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "as", "was", "be", "by", "it", "from", "at", "this", "or", "an", "are",
    "le", "la", "les", "de", "des", "du", "et", "en", "un", "une", "que", "qui", "pour", "dans", "est", "par", "sur", "au", "il", "elle",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "el", "los", "las", "y", "del", "se", "por", "con", "para", "su", "al", "lo", "como", "una", "no",
)


def signatures(text: Column, anchors: tuple[str, ...] = ANCHORS, chain: int = 2, reach: int = 8) -> Column:
    """The ascending set of 64-bit digests of an anchor and the ``chain`` content words after it.

    Words are runs of letters and digits, lower-cased. A chain that the text's end cuts short is left out. A word with no
    anchor among the ``reach`` words before it starts a chain of ``chain`` + 1 of the text's own words: stretches without
    anchors, as in other languages or in lists, have signatures too, and the same ones in every text. A text too
    short for any has the digest of the whole text, so equal texts have equal, never empty, sets. A null text
    counts as an empty one.
    """
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(F.lower(whole), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    common = sorted(set(anchors))
    none = F.array().cast("array<int>")

    def found(w: Column) -> Column:
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(none)
        content = F.filter(w, lambda x: ~x.isin(common))

        def spots(at: Column) -> Column:
            # the j-th anchor stands at p, so p - j content words precede it
            return let(content, lambda c: F.transform(at, lambda p, j: F.when(p - j + chain <= F.size(c), F.xxhash64(F.get(w, p), *[F.get(c, p - j + k) for k in range(chain)]))))

        def own(at: Column) -> Column:
            # from beyond the reach of an anchor, or the text's start, to the next anchor, or where the last chain starts
            last = F.size(w) - chain
            froms, tos = F.concat(F.array(F.lit(0)), F.transform(at, lambda p: p + reach + 1)), F.concat(at, F.array(last))
            starts = F.flatten(F.zip_with(froms, tos, lambda a, b: let(F.least(b, last), lambda end: F.when(a < end, F.sequence(a, end - 1)).otherwise(none))))
            return F.transform(starts, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(chain + 1)]))

        return let(F.filter(places, lambda i: F.get(w, i).isin(common)), lambda at: F.filter(F.concat(spots(at), own(at)), lambda h: h.isNotNull()))

    digests = let(words, lambda w: let(found(w), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.xxhash64(whole)))))
    return F.array_sort(F.array_distinct(digests))


def pruned_jaccard(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Similarity of two sets; 0 without a look at their members where sizes or ranges forbid ``threshold`` or any common one.

    Both are ascending and not empty; a null set gives null.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    apart = (F.element_at(a, -1) < F.get(b, F.lit(0))) | (F.element_at(b, -1) < F.get(a, F.lit(0)))
    exact = let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(a) + F.size(b) - n))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, 1.0).when(apart | (small < threshold * large), 0.0).otherwise(exact)


def fingerprint_text(spots: Column) -> Column:
    """The set as text: its digests in ascending order."""
    return F.array_join(spots.cast("array<string>"), " ")


def length_partition(size: Column, threshold: float) -> Column:
    """Partitions of set lengths such that similar sets are in one or in neighbouring partitions."""
    return F.floor(F.log(size.cast("double")) / -log(threshold) + 1e-9).cast("int")


def similar_pairs(fingerprints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``a``, ``b`` (a < b) and ``similarity`` of all pairs of different sets at or above the threshold; ``id``, ``spots`` are given.

    Equal sets are one class, named by its smallest id (see ``classes``). A set is listed under its rarest
    digests only: two sets of sizes m <= n at the threshold share one among the rarest n - ceil(t n) + 1
    of each, so digests of passages that many documents have hardly ever list a set. Listed entries meet
    by digest, in one or in neighbouring length partitions.
    """
    one = classes(fingerprints).groupBy("spots").agg(F.min("id").alias("id"))
    sized = one.withColumns({"n": F.size("spots"), "part": length_partition(F.size("spots"), threshold)})
    every = sized.select("id", "n", "part", F.explode("spots").alias("spot"))
    common = every.groupBy("spot").agg(F.count("*").alias("sets"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("sets", "spot"))
    listed = F.col("rank") <= F.col("n") - F.ceil(threshold * F.col("n") - F.lit(1e-9)).cast("int") + 1
    entries = every.join(common, "spot").withColumn("rank", rank).where(listed & (F.col("sets") > 1)).drop("rank", "sets")
    near = entries.select("id", "n", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "spot")
    left, right = near.alias("l"), entries.alias("r")
    met = left.join(right, (F.col("l.spot") == F.col("r.spot")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.id") != F.col("r.id")))
    met = met.where(F.least("l.n", "r.n") >= threshold * F.greatest("l.n", "r.n") - 1e-9).select(F.least("l.id", "r.id").alias("a"), F.greatest("l.id", "r.id").alias("b")).distinct()
    with_sets = met.join(one.select(F.col("id").alias("a"), F.col("spots").alias("sa")), "a").join(one.select(F.col("id").alias("b"), F.col("spots").alias("sb")), "b")
    return with_sets.select("a", "b", pruned_jaccard(F.col("sa"), F.col("sb"), threshold).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def classes(fingerprints: DataFrame) -> DataFrame:
    """``id`` and ``spots`` of usable rows, ``class``: the smallest id with the same set."""
    usable = fingerprints.where(F.col("id").isNotNull() & F.col("spots").isNotNull())
    least = usable.groupBy("spots").agg(F.min("id").alias("class"))
    return usable.join(least, "spots").select("id", "spots", "class")


def followed(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``doc_id``, ``text``, ``spots`` of every document with ``next_text``, ``next_spots`` of the next one by descending doc_id.

    After the last comes the first; a single document follows itself. Rows with equal doc_id stand by the
    digest of their text, a null doc_id comes last. Order is kept in buckets of ids between quantiles; the first
    row of each bucket is also the last of the bucket before, as a guest, so no task sees all rows.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_and_text(docs)
    low = -(2**63)
    keyed = rows.withColumn("key", F.coalesce("doc_id", F.lit(low)))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(keyed.agg(F.percentile_approx("key", shares or [0.5], 10_000)).first()[0] or [])) if buckets > 1 else []
    # binary search: the number of cuts at or above the key, so that buckets ascend as ids descend
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<long>")
    steps = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length())))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def narrow(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        right = (a["lo"] < a["hi"]) & (F.get(bounds, mid) < F.col("key"))
        return F.struct(F.when(right, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(right | (a["lo"] >= a["hi"]), a["hi"]).otherwise(mid).alias("hi"))

    bucket = F.lit(len(cuts)) - F.aggregate(steps, start, narrow, lambda a: a["lo"])
    dealt = keyed.withColumns({"bucket": bucket, "tie": F.xxhash64("text")})
    heads = dealt.groupBy("bucket").agg(F.min(F.struct((-F.col("key").cast("decimal(20,0)")).alias("down"), "tie")).alias("head"))
    # a row for each bucket: the bucket before it takes its first row as a guest
    ring = Window.orderBy("bucket")
    hosts = heads.withColumn("host", F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    hosts = hosts.select("bucket", F.col("head.tie").alias("tie"), (-F.col("head.down")).cast("long").alias("key"), "host")
    guests = dealt.join(F.broadcast(hosts), ["bucket", "key", "tie"]).dropDuplicates(["bucket"])
    plain = ["doc_id", "text", "key", "tie"]
    both = dealt.select(*plain, "bucket", F.lit(0).alias("guest")).union(guests.select(*plain, F.col("host"), F.lit(1)))
    both = both.repartition(max(buckets, 1), "bucket").withColumn("spots", signatures(F.col("text")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), "tie")
    return both.withColumns({"next_text": F.lead("text").over(order), "next_spots": F.lead("spots").over(order)}).where("guest = 0").select("doc_id", "text", "spots", "next_text", "next_spots")
