"""How far the sources of a language lie apart in their words, and which words set a source apart.

Each language keeps the terms of at least ``min_docs`` of its documents. A group, one source in one
language, gives each kept term the smoothed probability, in billionths,
``1 + (10**9 * (count + add)) div (total + add * V)``; all arithmetic is in integers. The distance of
two groups is the sum of the absolute differences over all kept terms.

Terms are dealt into blocks by their digest. A block has its postings by term and by group; each
group walks its own terms and scatters each through that term's postings into one dense
accumulator with a place for every other group (Gustavson's row by row product), so no pair of
postings is ever a row. A term that a group doesn't have counts with the group's zero value: a group's
distances to the other groups' zero values come from its sorted values and their running sums, and the
scatter corrects them where both groups have the term. Blocks add up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import byte_table, materialise, slices

#: ASCII letters, lower-cased, and everything beyond ASCII.
LETTERS = byte_table(b"abcdefghijklmnopqrstuvwxyz")


def term_counts(docs: DataFrame, held: int = 400_000) -> DataFrame:
    """``lang, source, term, n, df``: occurrences, and documents that hold the term, by group.

    A task counts in memory and hands on its counts whenever it holds ``held`` of them.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in groups.items():
                terms, k = pa.array(list(n), pa.binary()).cast(pa.string()), len(n)
                whole = pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(lang), k), pa.repeat(pa.scalar(source), k), terms, pa.array(list(n.values()), pa.int64()), pa.array([df[t] for t in n], pa.int64())],
                    schema=schema,
                )
                yield from (whole.slice(at, 50_000) for at in range(0, k, 50_000))
            groups.clear()

        for batch in slices(batches):
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                n, df = groups.setdefault((lang, source), (Counter(), Counter()))
                words, before = text.encode().translate(LETTERS).split(), len(n)
                n.update(words)
                df.update(set(words))
                size += len(n) - before
            if size >= held:
                yield from out()
                size = 0
        yield from out()

    partial = docs.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _parts(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``1 + (10**9 * count) div total`` without leaving 64 bits, by long division in three steps of a thousand."""
    rest, found = count, np.zeros_like(count)
    for _ in range(3):
        rest = rest * 1000
        found = found * 1000 + rest // total
        rest = rest % total
    return found + 1


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the ranges that begin at ``starts``, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def _from_zero(sorted_p: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """For each of ``zeros``, the sum of its distances to all of ``sorted_p``."""
    before = np.concatenate(([0], np.cumsum(sorted_p)))
    below = np.searchsorted(sorted_p, zeros)
    return zeros * (2 * below - len(sorted_p)) + before[-1] - 2 * before[below]


def block_result(postings: pa.Table, groups: pa.Table, add: int, top: int, stripe: int, width: int, scatter: int = 2_000_000) -> Iterator[tuple[str, str, str, int]]:
    """One block's part of the distances of the groups of a stripe to all later groups, and the block's best terms of these groups.

    ``groups`` are all groups of the language (``source, total``, and the language's ``v, lang_total``);
    ``postings`` are the block's (``source, term, n, lang_n``). Yields rows of part, source, item and value.
    """
    names = groups.column("source").to_pylist()
    order = sorted(range(len(names)), key=names.__getitem__)
    names = [names[i] for i in order]
    totals = groups.column("total").to_numpy()[order]
    v, lang_total = groups.column("v")[0].as_py(), groups.column("lang_total")[0].as_py()
    below = np.maximum(totals + add * v, 1)
    zeros = _parts(np.full(len(names), add, np.int64), below) if v else np.zeros(len(names), np.int64)

    place = {name: i for i, name in enumerate(names)}
    owner = np.array([place[s] for s in postings.column("source").to_pylist()], np.int64)
    coded = postings.column("term").combine_chunks().dictionary_encode()
    words, term = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
    p = _parts(postings.column("n").to_numpy() + add, below[owner]) if len(owner) else np.zeros(0, np.int64)

    by_term = np.argsort(term, kind="stable")  # the term-major index
    first = np.searchsorted(term[by_term], np.arange(len(words) + 1))
    peer, peer_p = owner[by_term], p[by_term]
    by_group = np.argsort(owner, kind="stable")
    begin = np.searchsorted(owner[by_group], np.arange(len(names) + 1))
    rows = [by_group[begin[i] : begin[i + 1]] for i in range(len(names))]
    own = range(stripe * width, min((stripe + 1) * width, len(names)))
    # distances of every group's terms to the zero values of the stripe's groups
    to_stripe = np.stack([_from_zero(np.sort(p[r]), zeros[own.start : own.stop]) for r in rows])
    sizes = np.diff(begin)

    lang_n = postings.column("lang_n").to_numpy()
    for i in own:
        sums = np.zeros(len(names), np.int64)
        mine = rows[i]
        lengths = first[term[mine] + 1] - first[term[mine]]
        for part in np.split(np.arange(len(mine)), np.searchsorted(np.cumsum(lengths), np.arange(scatter, lengths.sum(), scatter))):
            of, n = mine[part], lengths[part]
            at = _ranges(first[term[of]], n)
            a, b, z = np.repeat(p[of], n), peer_p[at], zeros[peer[at]]
            np.add.at(sums, peer[at], np.abs(a - b) - np.abs(a - z) - np.abs(zeros[i] - b) + np.abs(zeros[i] - z))
        apart = np.abs(zeros[i] - zeros)
        sums += _from_zero(np.sort(p[mine]), zeros) + to_stripe[:, i - own.start] + (len(words) - sizes[i] - sizes) * apart
        yield from (("pair", names[i], names[j], int(sums[j])) for j in range(i + 1, len(names)))

        value = p[mine] - _parts(lang_n[mine] + add, np.full(len(mine), lang_total + add * v, np.int64)) if len(mine) else np.zeros(0, np.int64)
        if (value > 0).sum() > top:
            best = value >= np.partition(value, -top)[-top]  # and all that tie with the last
        else:
            best = value > 0
        found = sorted((-int(x), words[t]) for x, t in zip(value[best], term[mine][best], strict=True))
        yield from (("term", names[i], word, -x) for x, word in found[:top] if x < 0)


def source_divergence(
    docs: DataFrame, min_docs: int = 30, add: int = 5, top: int = 50, block_postings: int = 50_000, width: int = 512
) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources, and the terms above the language's share.

    Null text, lang and source are ''; every (lang, source) that occurs is a group, also without terms or kept
    terms (distances are 0 where a language keeps none). Part ``pair`` has all ranks, part ``term`` the first ``top``;
    equal values stand in order of the item's bytes. Repeated rows count as documents of their own, an empty table
    gives none, other columns aren't read. A task has from ``block_postings`` to 40 times as
    many postings of one language (more where the language has many groups, so that blocks have no more pairs than postings) and
    the accumulators of ``width`` groups, one after the other.
    """
    plain = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    over = Window.partitionBy("lang", "term")
    counted = term_counts(plain).withColumns({
        "docs": F.sum("df").over(over), "lang_n": F.sum("n").over(over), "fresh": (F.col("source") == F.min("source").over(over)).cast("long"),
    })
    kept = materialise(counted.where(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "fresh"), "terms")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("fresh").alias("fresh"), F.count("*").alias("postings"))
    groups = materialise(plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0), "groups")
    # as many postings as a block has pairs, within bounds
    size = F.least(F.greatest(F.count("*") * F.count("*") / 2, F.lit(block_postings)), F.lit(40 * block_postings))
    langs = groups.groupBy("lang").agg(
        F.sum("fresh").alias("v"), F.sum("total").alias("lang_total"),
        F.greatest(F.lit(1), F.ceil(F.sum("postings") / size)).cast("int").alias("blocks"), F.ceil(F.count("*") / width).cast("int").alias("stripes"),
    )
    langs = materialise(langs, "langs")  # so that Spark sees how small it is
    stripes = F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe")

    key = ["lang", "block", "stripe"]
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    postings = kept.join(langs, "lang").select("lang", block, stripes, "source", "term", "n", "lang_n")
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    wide = groups.join(langs, "lang").select("lang", blocks, "stripes", "source", "total", "v", "lang_total").select("lang", "block", stripes, "source", "total", "v", "lang_total")

    schema = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def work(at, left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(block_result(left, right, add, top, at[2].as_py(), width))
        columns = list(zip(*found, strict=True)) or [()] * 4
        return pa.Table.from_arrays([pa.repeat(pa.scalar(at[0].as_py(), pa.string()), len(found)), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    found = materialise(
        postings.groupBy(*key).cogroup(wide.groupBy(*key)).applyInArrow(work, "lang string, part string, source string, item string, value long"), "blocks"
    )
    pairs = found.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("two")
    pairs = pairs.select("lang", "part", both, "value").select("lang", "part", "two.source", "two.item", "value")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    terms = found.where("part = 'term'").withColumn("rank", place).where(F.col("rank") <= top)
    return pairs.withColumn("rank", place).select(out).union(terms.select(out))
