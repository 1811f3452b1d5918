"""Concept labels and near-title matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions.arrow import fold, ratcliff_ratio
from corpusflow.functions.basic import let
from corpusflow.functions.text import latin_words
from corpusflow.operators.title_keys import Filter, Keys, by_length, gathered, sketches, slots
from corpusflow.session import materialise

#: Characters of a phrase that bring texts and phrases together.
GRAM = 12
#: Places of the filter of phrase pieces at its largest; more phrases than a tenth of it let more pieces through.
FILTER_SLOTS = 1 << 20
#: Shares of a common piece's hits; each has all phrases of the piece.
PIECE_SALTS = 16
#: The filter of title segments has at most two to this power bits (64 MB); more segments let more windows through.
SEGMENT_BITS = 29


def phrase_anchors(phrases: DataFrame) -> DataFrame:
    """``_needle``, ``_concept``, ``_gram`` (the piece a text and the phrase meet on), ``_before`` (words of the phrase before it), ``_words``.

    A phrase of several words meets on the first characters of one of its words but the first, which in a text
    may be the end of a longer one: a piece of full length if it has one, of these the one with the fewest blanks, since
    long words are rarer than short ones, then the earliest. A phrase of one word meets on its first characters.
    """

    def anchor(words: Column) -> Column:
        place = F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1)).otherwise(F.array(F.lit(0)))
        piece = lambda i: F.left(F.array_join(F.slice(words, i + 1, F.lit(GRAM)), " "), F.lit(GRAM))
        ranked = lambda g, i: F.struct((-F.length(g)).alias("short"), F.regexp_count(g, F.lit(" ")).alias("blanks"), i.alias("before"), g.alias("gram"))
        return F.array_min(F.transform(place, lambda i: let(piece(i), lambda g: ranked(g, i))))

    words = F.split("_needle", " ")
    chosen = phrases.select("_needle", "_concept", F.size(words).alias("_words"), let(words, anchor).alias("a"))
    return chosen.select("_needle", "_concept", F.col("a.gram").alias("_gram"), F.col("a.before").alias("_before"), "_words")


def concept_label(df: DataFrame, text: str, concepts: DataFrame, concept: str, out: str = "concept") -> DataFrame:
    """Label each text with the longest concept phrase it contains, '' if none;
    equal lengths are settled by name.

    A phrase may start and end inside a word. Each phrase has one piece it is looked for by
    (``phrase_anchors``). In a text's own row its pieces go through a filter of the phrases' pieces, and only those that
    pass leave the row, with the words around them, in which the phrase is then verified. So what is shuffled is a few
    words a hit and never the text, unless the caller keeps it. Hits on a common piece are dealt over salts.
    """
    phrases = (
        concepts.select(F.col(concept).alias("_concept"), latin_words(concept).alias("_needle"))
        .where("_needle <> ''")
        .groupBy("_needle")
        .agg(F.min(F.struct(-F.char_length("_concept"), "_concept")).getField("_concept").alias("_concept"))
    )
    keyed = phrase_anchors(phrases)
    slot = lambda g, slots: F.pmod(F.xxhash64(g), F.lit(slots)).cast("int")
    # 32 rows at most: what pieces there are, how far a phrase reaches around its piece, and the filter's bits
    bits = keyed.withColumn("_slot", slot(F.col("_gram"), FILTER_SLOTS) + 1).groupBy(F.bitmap_bucket_number("_slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("bits"), F.count("*").alias("n"),
        F.collect_set(F.struct(F.col("_words") > 1, F.length("_gram"))).alias("kinds"), F.max("_before").alias("before"),
        F.max(F.col("_words") - F.col("_before")).alias("after"), F.max(F.when(F.col("_words") == 1, F.length("_needle"))).alias("single"),
    ).collect()
    if not bits:
        return df.withColumn(out, F.lit(""))
    slots = 1 << 10
    while slots < FILTER_SLOTS and slots < 16 * sum(b["n"] for b in bits):
        slots *= 2
    marks = np.zeros(FILTER_SLOTS, np.uint8)
    for b in bits:
        at = (b["bucket"] - 1) * 32_768
        marks[at : at + 32_768] = np.unpackbits(np.frombuffer(b["bits"], np.uint8), bitorder="little")
    passing = F.lit(marks.reshape(-1, slots).max(0).tobytes())
    sizes = sorted({tuple(kind) for b in bits for kind in b["kinds"]})  # 24 at most
    before, after, single = (max(b[c] or 0 for b in bits) for c in ("before", "after", "single"))

    def hits(hay: Column, words: Column) -> Column:
        found = []
        for many, size in sizes:
            # a look-ahead yields overlapping pieces in one scan; the i-th starts at the i-th place (word but the first) of the text
            pieces = F.regexp_extract_all(hay, F.lit(f"{'(?<= )' if many else ''}(?=(.{{{size}}}))"), F.lit(1))
            placed = F.transform(pieces, lambda g, i: F.struct(g.alias("g"), i.cast("int").alias("i")))
            passed = F.filter(placed, lambda p: F.substr(passing, slot(p["g"], slots) + 1, F.lit(1)) == F.lit(b"\x01"))
            if many:
                around = lambda i: F.array_join(F.slice(words, F.greatest(F.lit(1), i + 2 - before), F.lit(before + after)), " ")
            else:
                around = lambda i: F.substr(hay, i + 1, F.lit(single))
            found.append(F.transform(passed, lambda p: F.struct(p["g"].alias("g"), around(p["i"]).alias("around"))))
        return F.flatten(F.array(*found))  # array_distinct of structs compares all pairs

    keyed_text = F.md5(F.col(text).cast("binary"))
    # exploded as an expression: a filter on a column of hits would find them anew
    found = let(latin_words(text), lambda hay: let(F.split(hay, " "), lambda words: hits(hay, words)))
    met = df.select(keyed_text.alias("_text"), F.explode(found).alias("h"))
    met = met.select("_text", F.col("h.g").alias("_gram"), F.col("h.around").alias("_around"))
    met = met.withColumn("_salt", F.pmod(F.xxhash64("_text"), F.lit(PIECE_SALTS)).cast("int"))
    dealt = keyed.select("_gram", "_needle", "_concept", F.explode(F.sequence(F.lit(0), F.lit(PIECE_SALTS - 1))).alias("_salt"))
    inside = met.join(dealt, ["_gram", "_salt"]).where(F.contains("_around", "_needle"))
    best = inside.groupBy("_text").agg(F.min(F.struct(-F.char_length("_concept"), "_concept")).getField("_concept").alias("_best"))
    keyed_df = df.withColumn("_text", keyed_text)
    return keyed_df.join(best, "_text", "left").withColumn(out, F.coalesce("_best", F.lit(""))).drop("_text", "_best")


def normal_title(df: DataFrame, title: str, out: str) -> DataFrame:
    """Accent-free ``[a-z0-9]`` words of a title."""
    return df.withColumn("_folded", fold(title)).withColumn(out, latin_words("_folded")).drop("_folded")


def segment_filter(titles: DataFrame, keys: Keys, expected: int) -> np.ndarray:
    """Bits of a filter of the whole segments of titles (``norm``): sixteen a key, up to ``SEGMENT_BITS``."""
    size = min(SEGMENT_BITS, max(15, (16 * expected).bit_length()))

    def places(batches):
        for batch in batches:
            for _, text in by_length(batch["norm"].to_numpy(zero_copy_only=False)):
                found = [key for _, key in keys.of_cut(text, less=False)]
                if found:
                    yield pa.record_batch({"slot": np.unique(slots(np.concatenate(found), size))})

    marked = titles.select("norm").mapInArrow(places, "slot long").withColumn("slot", F.col("slot") + 1)
    parts = marked.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    bits = np.zeros(1 << size >> 3, np.uint8)
    for part in parts.collect():  # at most 64 MB
        at = (part["bucket"] - 1) * 4096
        bits[at : at + 4096] = np.frombuffer(part["bits"], np.uint8)
    return bits


def keyed_titles(titles: DataFrame, keys: Keys, whole: Broadcast | None = None) -> DataFrame:
    """``key``, ``id``, ``n`` (characters) and ``sketches`` of titles (``id``, ``norm``) that are cut or, with bits of a
    filter of whole segments, that segments are looked for in."""

    def keyed(batches):
        passing = None if whole is None else Filter(whole.value)
        for batch in batches:
            ids = batch["id"].to_numpy()
            for rows, text in by_length(batch["norm"].to_numpy(zero_copy_only=False)):
                own, counts = ids[rows], sketches(text)
                for column, key in gathered(keys.of_cut(text) if passing is None else keys.of_sought(text, passing)):
                    yield pa.record_batch({
                        "key": key.view(np.int64), "id": own[column], "n": np.full(len(key), len(text), np.int32),
                        **{f"s{k}": c[column] for k, c in enumerate(counts)},
                    })

    return titles.select("id", "norm").mapInArrow(keyed, "key long, id long, n int, s0 long, s1 long, s2 long")


def unlike(a: str, b: str) -> Column:
    """Sum of the differences of the counts in the ``sketches`` of two rows, or less (modulo 255); by
    fifteens, which is less work than a term for each count."""
    guards, low = F.lit(0x0888888888888888), F.lit(0x0F0F0F0F0F0F0F0F)

    def above(x: Column, y: Column) -> Column:
        d = x.bitwiseOR(guards) - y
        kept = d.bitwiseAND(guards)
        return d.bitwiseAND(kept - F.shiftright(kept, 3))

    def apart(k: int) -> Column:
        x, y = F.col(f"{a}.s{k}"), F.col(f"{b}.s{k}")
        return above(x, y).bitwiseOR(above(y, x))

    def by_twos(counts: Column) -> Column:
        return counts.bitwiseAND(low) + F.shiftright(counts, 4).bitwiseAND(low)

    return (by_twos(apart(0) + apart(1)) + by_twos(apart(2))) % 255


def near_titles(
    wanted: DataFrame,
    catalogue: DataFrame,
    title: str = "title",
    min_ratio: float = rules.TITLE_MATCH_MIN,
    min_words: int = rules.TITLE_MIN_WORDS,
) -> DataFrame:
    """Pairs of distinct normalised titles ``(norm, match, similarity)`` with a
    Ratcliff–Obershelp ratio of at least ``min_ratio``.

    No such pair is lost. Equal titles meet as they are. Two others meet on a segment of the one that stands in the
    other with a character too many or too few at most, near its own place (``title_keys``). Windows of the other, less a
    character, are many, and only those that pass a filter of the segments leave their task. What meets has like
    counts of characters and an edit distance of at most ``u``, which the JVM decides, before the ratio is computed.
    Copies of a title are one title here, so a crowd of copies costs nothing; join back on the normalised title.
    """
    spark = wanted.sparkSession

    def titles(df: DataFrame, side: int) -> DataFrame:
        # a filter on the title itself would compute it twice
        folded = df.select(fold(title).alias("folded")).where("folded is not null")
        return folded.select(latin_words("folded").alias("norm"), F.lit(side).alias("side"))

    # few bytes, much work: by number, so that they aren't put into one task
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one pass over both, one row a title; read several times below
    sides = titles(wanted, 1).union(titles(catalogue, 2)).groupBy("norm").agg(F.bit_or("side").alias("side"))
    sides = sides.where(F.size(F.split("norm", " ")) >= min_words).repartition(tasks)
    sides = materialise(sides.withColumn("id", F.monotonically_increasing_id()), "titles")
    equal = sides.where("side = 3").select("norm", F.col("norm").alias("match"), F.lit(1.0).alias("similarity"))
    left, right = sides.where("side <> 2 and norm <> ''"), sides.where("side <> 1 and norm <> ''")
    # a row a length; the empty title has no other to meet
    lengths = sides.where("norm <> ''").groupBy(F.length("norm").alias("n")).agg(F.count_if(F.col("side") != 2).alias("cut"), F.count_if(F.col("side") != 1).alias("sought")).collect()
    keys = Keys(min_ratio, [r["n"] for r in lengths if r["cut"]], [r["n"] for r in lengths if r["sought"]])
    whole = segment_filter(left, keys, sum(r["cut"] * keys.count(r["n"]) for r in lengths if r["cut"]))
    cut, sought = keyed_titles(left, keys), keyed_titles(right, keys, spark.sparkContext.broadcast(whole))

    def strays(a: Column, b: Column) -> Column:
        return F.floor((1 - min_ratio) * (a + b) + 1e-9).cast("int")

    met = (
        # the planner takes either side to be as small as the titles it is cut from, and would collect its rows in the driver
        cut.alias("a").hint("merge").join(sought.alias("b"), "key")
        .where((F.col("a.id") != F.col("b.id")) & (F.abs(F.col("a.n") - F.col("b.n")) <= strays(F.col("a.n"), F.col("b.n"))) & (unlike("a", "b") <= strays(F.col("a.n"), F.col("b.n"))))
        .select(F.col("a.id").alias("ida"), F.col("b.id").alias("idb"))
        .distinct()
    )
    named = lambda side: sides.select(F.col("id").alias(f"id{side}"), F.col("norm").alias(side)).hint("merge")
    n = lambda side: F.length(side)
    near = (
        met.join(named("a"), "ida").join(named("b"), "idb")
        .where(F.call_function("levenshtein", F.col("a"), F.col("b"), strays(n("a"), n("b"))) >= 0)
        .select("a", "b").repartition(tasks)
    )
    scored = near.withColumn("similarity", ratcliff_ratio(F.col("a"), F.col("b"), min_ratio)).where(F.col("similarity") >= min_ratio)
    return equal.union(scored.select(F.col("a").alias("norm"), F.col("b").alias("match"), "similarity"))
