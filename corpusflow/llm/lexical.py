"""Ranked lexical search of a set of items over all documents, in integers.

Postings are owned by terms. The items' terms are dealt to a few owners, rare terms (large weights) first, common
ones last. Items travel in bundles: a bundle starts with no accumulators and meets the owners one after the
other; at each it is cogrouped with the owner's postings, adds their integer contributions to its
sparse (document, score) accumulators and moves on. After the last owner the best documents are chosen.

No task holds all accumulators of an item: documents come in chunks of bounded size, and a bundle has one part for each chunk.
What a bundle carries is pruned without loss. If ``rest`` is the most that the owners still to come can add, an
accumulator that ``rest`` can't lift to the bundle's k-th best score so far isn't carried on, and
once ``rest`` alone is below that score no document enters any more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import byte_table, id_and_text, materialise, slices

#: ASCII letters, lower-cased, digits, and everything beyond ASCII.
WORD_BYTES = byte_table(b"abcdefghijklmnopqrstuvwxyz0123456789")

#: A row for each term of a chunk, and one for the chunk itself (term -1: its documents' ids and sizes).
INDEX = pa.schema([
    ("chunk", pa.int64()), ("term", pa.int32()), ("docs", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())),
    ("ids", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
])
#: A row for each item of a bundle's part, and one for the chunk (item -1: its documents' ids and length factors).
BUNDLE = pa.schema([("chunk", pa.int64()), ("bundle", pa.int32()), ("item", pa.int32()), ("docs", pa.list_(pa.int32())), ("scores", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64()))])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int32()): "array<int>", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def words(text: str) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split()


def _items(items: DataFrame) -> DataFrame:
    """``row``, ``item_id`` and the distinct ``terms`` of each item that has any."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(words(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(terms, pa.list_(pa.binary()))], names=["row", "item_id", "terms"])

    plain = id_and_text(items, "item_id").withColumn("row", F.monotonically_increasing_id())
    return materialise(plain.mapInArrow(cut, "row long, item_id long, terms array<binary>").where(F.size("terms") > 0), "items")


def index(docs: DataFrame, vocabulary: list[bytes], chunk_docs: int = 16_384) -> DataFrame:
    """The postings of the sorted ``vocabulary`` in whole documents, by chunk and term, with every chunk's counts."""
    number = {w: i for i, w in enumerate(vocabulary)}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        wanted = number.keys()
        ids, sizes, n_docs, n_terms = [], [], 0, 0
        term, doc, tf = [], [], []

        def out() -> list[pa.RecordBatch]:
            t, d, f = (np.array(x, np.int32) for x in (term, doc, tf))
            order = np.argsort(t, kind="stable")
            t, d, f = t[order], d[order], f[order]
            own, first = np.unique(t, return_index=True)
            ends = pa.array(np.concatenate((first, [len(t)])), pa.int32())
            k = len(own)
            post = pa.RecordBatch.from_arrays(
                [
                    pa.repeat(pa.scalar(chunk), k), pa.array(own), pa.ListArray.from_arrays(ends, d), pa.ListArray.from_arrays(ends, f),
                    pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                ],
                schema=INDEX,
            )
            head = pa.RecordBatch.from_pylist([{"chunk": chunk, "term": -1, "docs": sizes, "ids": ids, "n_docs": n_docs, "n_terms": n_terms}], schema=INDEX)
            return [post, head] if k else [head]

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = words(text)
                n_docs += bool(found)
                n_terms += len(found)
                counts = Counter(found)
                if hits := counts.keys() & wanted:
                    term += [number[w] for w in hits]
                    tf += [counts[w] for w in hits]
                    doc += [len(ids)] * len(hits)
                    ids.append(doc_id)
                    sizes.append(len(found))
            if len(ids) >= chunk_docs:
                yield from out()
                chunk, n_docs, n_terms = chunk + 1, 0, 0
                for x in (ids, sizes, term, doc, tf):
                    x.clear()
        if n_docs:
            yield from out()

    return materialise(id_and_text(docs).mapInArrow(build, ddl(INDEX)), "postings")


def contribution(tf, m):
    """What a weight of 1 adds for ``tf`` occurrences in a document with the length factor ``m``."""
    return 10**9 * tf // (1000 * tf + 20 * m)


class Items:
    """A block's items as every task needs them: each one's bundle and its terms by owner, with weights and the most they can add."""

    def __init__(self, terms: list[list[int]], owner: np.ndarray, weight: np.ndarray, most_tf: np.ndarray, owners: int, k: int):
        self.terms, self.owner, self.weight, self.most_tf, self.owners, self.k = terms, owner, weight, most_tf, owners, k

    def rest(self, item: int, stage: int, least_m: int) -> int:
        """The most that owners from ``stage`` on can add to a document of a chunk whose length factors are ``least_m`` or more."""
        own = [t for t in self.terms[item] if self.owner[t] >= stage]
        return sum(int(self.weight[t]) * contribution(int(self.most_tf[t]), least_m) for t in own)


def stage_scores(items: Items, own: list[int], stage: int, carried: pa.Table, postings: pa.Table) -> tuple[dict[int, tuple[np.ndarray, np.ndarray]], np.ndarray, list]:
    """A bundle's accumulators after one owner, with the chunk's length factors and ids."""
    head = carried.filter(pa.compute.equal(carried.column("item"), -1))
    m, ids = head.column("docs")[0].values.to_numpy().astype(np.int64), head.column("ids")[0]
    held = {i: (d.values.to_numpy(), s.values.to_numpy()) for i, d, s in zip(carried.column("item").to_pylist(), carried.column("docs"), carried.column("scores"), strict=True) if i >= 0}
    adds = {}
    for t, d, f in zip(postings.column("term").to_pylist(), postings.column("docs"), postings.column("tfs"), strict=True):
        docs = d.values.to_numpy()
        adds[t] = docs, int(items.weight[t]) * contribution(f.values.to_numpy().astype(np.int64), m[docs])
    least, sums, out = int(m.min()) if len(m) else 1, np.zeros(len(m), np.int64), {}
    for item in own:
        docs, scores = held.get(item, (np.zeros(0, np.int32), np.zeros(0, np.int64)))
        least_score = int(np.partition(scores, -items.k)[-items.k]) if len(scores) >= items.k else 0
        closed = items.rest(item, stage, least) < least_score
        sums[docs] = scores
        touched = [docs]
        for t in items.terms[item]:
            if t in adds:
                sums[adds[t][0]] += adds[t][1]
                touched.append(adds[t][0])
        if not closed:
            docs = np.flatnonzero(sums).astype(np.int32)
        scores = sums[docs]
        for some in touched:
            sums[some] = 0
        if len(scores) >= items.k:
            good = scores + items.rest(item, stage + 1, least) >= np.partition(scores, -items.k)[-items.k]
            docs, scores = docs[good], scores[good]
        if len(docs):
            out[item] = docs, scores
    return out, m, ids


def _search_block(docs: DataFrame, rows: list[list[bytes]], k: int, owners: int, bundle_items: int, chunk_docs: int) -> DataFrame:
    """``number`` (the item's place in ``rows``, each the terms of an item), ``doc_id``, ``score``: each chunk's best documents of each item."""
    spark = docs.sparkSession
    vocabulary = sorted({w for own in rows for w in own})
    number = {w: i for i, w in enumerate(vocabulary)}
    found = index(docs, vocabulary, chunk_docs)

    total = found.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, length = total[0] or 0, total[1] or 0
    stats = found.where("term >= 0").groupBy("term").agg(F.sum(F.size("docs")).alias("df"), F.max(F.array_max("tfs")).alias("tf")).collect()  # a row for each term of the block
    df, most_tf = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    for r in stats:
        df[r["term"]], most_tf[r["term"]] = r["df"], r["tf"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    # the last owner has about half of the postings, the one before it a quarter, the first ones the rare terms
    rare = np.argsort(df, kind="stable")
    share = np.cumsum(df[rare]) / max(1, int(df.sum()))
    owner = np.zeros(len(vocabulary), np.int64)
    owner[rare] = np.searchsorted([0.5**s for s in range(owners - 1, 0, -1)], share)
    terms = [[number[w] for w in own] for own in rows]
    items = Items(terms, owner, weight, most_tf, owners, k)
    bundles = -(-len(rows) // bundle_items)
    used: dict[int, set[int]] = {}
    for i, own in enumerate(terms):
        for t in own:
            used.setdefault(t, set()).add(i // bundle_items)
    uses = spark.createDataFrame([(t, int(owner[t]), sorted(b)) for t, b in used.items()], "term int, owner int, bundles array<int>")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            factors = {x: 50 + 50 * x * n // length for x in set(row["docs"])}  # Python's integers have no bound
            m = [factors[x] for x in row["docs"]]
            yield pa.RecordBatch.from_pylist([{"chunk": row["chunk"], "bundle": b, "item": -1, "docs": m, "ids": row["ids"]} for b in range(bundles)], schema=BUNDLE)

    def visit(stage: int):
        last = stage == owners - 1

        def add(at, carried: pa.Table, postings: pa.Table) -> pa.Table:
            chunk, bundle = (x.as_py() for x in at)
            own = list(range(bundle * bundle_items, min((bundle + 1) * bundle_items, len(rows))))
            scores, m, ids = stage_scores(items, own, stage, carried, postings)
            if last:
                names, best = ids.values, []
                order = np.array([np.iinfo(np.int64).max if x is None else x for x in names.to_pylist()], np.int64)
                for item, (d, s) in scores.items():
                    top = np.lexsort((order[d], -s))[:k]
                    best.append((np.full(len(top), item), d[top], s[top]))
                item, d, s = (np.concatenate([b[c] for b in best] or [np.zeros(0, np.int64)]) for c in range(3))
                return pa.table({"number": pa.array(item, pa.int32()), "doc_id": names.take(pa.array(d, pa.int32())), "score": pa.array(s, pa.int64())})
            kept = [{"chunk": chunk, "bundle": bundle, "item": -1, "docs": m, "ids": ids.as_py()}]
            kept += [{"chunk": chunk, "bundle": bundle, "item": item, "docs": d, "scores": s} for item, (d, s) in scores.items()]
            return pa.Table.from_arrays([pa.array([r.get(f.name) for r in kept], f.type) for f in BUNDLE], schema=BUNDLE)

        return add

    key = ["chunk", "bundle"]
    carried = found.where("term = -1 and size(ids) > 0").select("chunk", "docs", "ids").mapInArrow(start, ddl(BUNDLE))
    post = found.where("term >= 0").join(F.broadcast(uses), "term")  # the block's terms, bounded by block_bytes
    for stage in range(owners):
        own = post.where(F.col("owner") == stage).select("chunk", F.explode("bundles").alias("bundle"), "term", "docs", "tfs")
        out = "number int, doc_id long, score long" if stage == owners - 1 else ddl(BUNDLE)
        carried = carried.groupBy(*key).cogroup(own.groupBy(*key)).applyInArrow(visit(stage), out)
    return carried


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, owners: int = 4, bundle_items: int = 256, block_bytes: int = 16 << 20, chunk_docs: int = 16_384
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0, equal scores by ascending doc_id.

    Every row of ``items`` is an item and every row of ``docs`` a document, repeated ids too; null texts have no terms, a null doc_id
    comes last among equal scores, a null item_id stays null. Items or documents without terms, and empty tables, give no rows. Other
    columns aren't read. Items come in blocks of about ``block_bytes`` of terms, each a pass over the documents.
    """
    found = _items(items)
    size = found.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.length(t) + 8))).first()[0] or 0
    blocks = -(-size // block_bytes)
    parts = []
    for block in range(blocks):
        rows = found.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").collect()  # about block_bytes
        if rows:
            names = found.sparkSession.createDataFrame([(i, r["row"], r["item_id"]) for i, r in enumerate(rows)], "number int, row long, item_id long")
            terms = [[bytes(w) for w in r["terms"]] for r in rows]
            parts.append(_search_block(docs, terms, k, owners, bundle_items, chunk_docs).join(F.broadcast(names), "number").drop("number"))
    if not parts:
        return found.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    best = parts[0]
    for part in parts[1:]:
        best = best.union(part)
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return best.where("score > 0").withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
