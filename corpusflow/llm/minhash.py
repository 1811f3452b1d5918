"""Near-duplicate documents by one-permutation MinHash.

A document is the set of its word shingles, hashed to 64 bits. One hash of each shingle both
chooses a bin and is the bin's value; the smallest value of a bin counts, and an empty bin borrows
the value of a non-empty bin chosen by a fixed random order of its own (optimal densification), so
that bins of two sets agree with the probability of their similarity. Bins are banded; equal bands
put documents in one bucket.

Documents with equal sets are one node from the start. In a bucket each node is paired with the
smallest node only (a star), so a bucket of n nodes has n - 1 candidate edges. Edges whose sizes or
sketches rule them out go; the others are confirmed on the full sets. A star alone can miss a link
between two nodes that aren't linked with the hub. So buckets whose nodes are still in several
components are gone through once more, in blocks of bounded size: their members' sets meet in a task,
and only pairs across components that are similar leave it, to be confirmed as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import id_and_text, materialise, slices

#: Bins of a band, and how rarely a pair at the threshold may share no band (see ``bands_for``).
ROWS, MISS = 8, 2.5e-7
#: Bins of which the sketch keeps a byte; six standard deviations below 0.8 rule a pair out.
SKETCH = 128
#: Nodes of a bucket, or of a hub's edges, that one group holds.
BLOCK = 256

_MIX1, _MIX2, _BASE = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def bands_for(percent: int) -> int:
    """Bands such that a pair of this similarity shares none with probability ``MISS``: 48 for 85, 83 for 80."""
    return max(SKETCH // ROWS, ceil(log(MISS) / log1p(-((percent / 100) ** ROWS)))) if percent < 100 else SKETCH // ROWS


class Shingler:
    """Turns texts into sets of hashed shingles, and sets into signatures. Made anew in each task."""

    def __init__(self, words: int = 5, bins: int = 48 * ROWS):
        rng = np.random.default_rng(20_240_117)
        self.words, self.bins = words, bins
        self.byte_value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
        #: for each bin the bins it may borrow from, as ranks in a random order
        self.borrow = rng.permuted(np.tile(np.arange(bins, dtype=np.uint16), (bins, 1)), axis=1)
        self.up = self.down = np.empty(0, np.uint64)

    def _powers(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            self.up, self.down = np.full(size, _BASE, np.uint64), np.full(size, _BASE_INVERSE, np.uint64)
            self.up[0] = self.down[0] = 1
            self.up, self.down = np.cumprod(self.up), np.cumprod(self.down)
        return self.up, self.down

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its distinct shingles, hashed and ascending.

        A-Z are lower-cased; words are runs of anything but blank, tab, newline, vertical tab, form
        feed and carriage return. A text with fewer words than a shingle is one shingle, one without
        words has none. A word's hash comes from running sums of its bytes' values times powers of
        an odd number, so that a batch takes a few array operations.
        """
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b" ".join([*raw, b" "]), np.uint8)
        ends_of_texts = np.cumsum([len(r) + 1 for r in raw])
        upper = (data >= 65) & (data <= 90)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        value = self.byte_value[np.where(upper, data | 32, data)]
        up, down = self._powers(1 << max(16, len(data).bit_length()))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up[: len(data)])))
        edge = np.diff(np.concatenate(([1], blank.astype(np.int8), [1])))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        hashed = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _MIX2)
        bounds = np.searchsorted(np.searchsorted(ends_of_texts, starts, side="right"), np.arange(len(texts) + 1)).tolist()
        chain = np.zeros(max(0, len(hashed) - self.words + 1), np.uint64)
        for j in range(self.words):
            chain = _mix(chain * _BASE + hashed[j : j + len(chain)])
        sets = []
        for first, last in zip(bounds, bounds[1:]):
            n = last - first
            if n >= self.words:
                sets.append(np.unique(chain[first : last - self.words + 1]))
            elif n:
                one = np.full(1, n, np.uint64)
                for j in range(first, last):
                    one = _mix(one * _BASE + hashed[j])
                sets.append(one)
            else:
                sets.append(np.empty(0, np.uint64))
        return sets

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The bins' values of a non-empty ascending set."""
        bin_of = ((shingles >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        at = np.flatnonzero(np.concatenate(([True], bin_of[1:] != bin_of[:-1])))
        full = bin_of[at].astype(np.int64)
        out = np.zeros(self.bins, np.uint64)
        out[full] = shingles[at]
        if len(full) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), full, assume_unique=True)
            out[empty] = out[full[self.borrow[np.ix_(empty, full)].argmin(axis=1)]]
        return out


def band_keys(values: np.ndarray, bands: int) -> np.ndarray:
    rows = values.reshape(bands, -1)
    key = np.arange(bands, dtype=np.uint64)
    for j in range(rows.shape[1]):
        key = _mix(key * _BASE + rows[:, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``set_key`` (digest of the set, null if empty) and ``bands``."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, bands * ROWS)
        for batch in slices(batches, size=1 << 20):
            sets = shingler.sets(batch.column("text").to_pylist())
            values = [shingler.signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([band_keys(v, bands) if v is not None else None for v in values], pa.list_(pa.int64())),
                ],
                schema=schema,
            )

    return id_and_text(docs).mapInArrow(sign, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _least_match(percent: int) -> int:
    """Equal bytes of a sketch below which a pair can't well be similar: six standard deviations off."""
    p = percent / 100
    return int(SKETCH * p - 6 * (SKETCH * p * (1 - p)) ** 0.5)


def candidate_sets(texts: DataFrame, nodes: DataFrame, words: int, bands: int) -> DataFrame:
    """``node``, ``n``, ``sketch``, ``shingles`` (ascending 64-bit hashes) and ``short`` (their upper halves) of the given nodes.

    The nodes that share a bucket grow with the corpus, so they are never broadcast.
    """
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("sketch", "shingles", "short"))])

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words, bands * ROWS)
        for batch in slices(batches, size=1 << 20):
            sets = shingler.sets(batch.column("text").to_pylist())
            rows = [(i, len(s), shingler.signature(s)[:SKETCH].astype(np.uint8).tobytes(), s.tobytes(), (s >> np.uint64(32)).astype("<u4").tobytes()) for i, s in zip(batch.column("node").to_pylist(), sets, strict=True) if len(s)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    own = texts.select(F.col("doc_id").alias("node"), "text").join(nodes.hint("merge"), "node", "left_semi")
    return own.mapInArrow(shingle, "node long, n long, sketch binary, shingles binary, short binary")


def _plausible(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of edges (a, b) those that sizes and sketches leave possible."""
    least = _least_match(percent)
    end = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    sized = edges.join(end("a"), "a").join(end("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("s_a", "s_b"))
            kept = pa.array((one == two).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(kept)

    return sized.select("a", "b", "s_a", "s_b").mapInArrow(keep, "a long, b long").distinct()


def confirm(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of edges (a, b) those with 100 * intersection >= percent * union on the full sets.

    Edges are gathered by ``b``, in parts of about ``BLOCK``, each with its own copy of b's set, and
    read as a sorted stream: a task holds one set of b (each, if its id has several texts) at a time.
    """
    parts = edges.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    hub = parts.select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int"))).alias("part"), F.col("b").alias("node"), F.lit(0).alias("kind"))
    leaf = edges.join(parts, "b").select(F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"), F.col("a").alias("node"), F.lit(1).alias("kind"))
    rows = hub.union(leaf).join(sets.select("node", "shingles"), "node")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hubs = None, []
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                own = np.frombuffer(row["shingles"], np.uint64)
                if (row["hub"], row["part"]) != group:
                    group, hubs = (row["hub"], row["part"]), []
                if row["kind"] == 0:
                    hubs.append(own)
                    continue
                for other in hubs:
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found.append((row["node"], row["hub"]))
                        break
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node it reaches) of every node with an edge.

    Alternating large and small stars: each round is an aggregate and a join on the node, and every
    round is written to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    stars = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before = None
    while True:
        # large star: larger neighbours of u go to the smallest node around u
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        stars = materialise(small, "stars")
        state = stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        before = state


def _similar(group: list[tuple], percent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group of (node, component, n, sketch, short) across components whose short sets are similar.

    Equal upper halves of different hashes can only make two sets look more similar, so no link is lost.
    """
    node, component, n = (np.array([r[k] for r in group]) for k in (0, 1, 2))
    sketch = np.frombuffer(b"".join(r[3] for r in group), np.uint8).reshape(-1, SKETCH)
    short = [np.frombuffer(r[4], "<u4") for r in group]
    a, b = [node[:0]], [node[:0]]
    for x in range(len(group) - 1):
        small, big = np.minimum(n[x], n[x + 1 :]), np.maximum(n[x], n[x + 1 :])
        near = np.flatnonzero((component[x + 1 :] != component[x]) & (100 * small >= percent * big)) + x + 1
        near = near[(sketch[near] == sketch[x]).sum(axis=1) >= least]
        if len(near):
            others = np.concatenate([short[i] for i in near])
            at = np.minimum(np.searchsorted(short[x], others), len(short[x]) - 1)
            both = np.add.reduceat((short[x][at] == others).astype(np.int64), np.cumsum(n[near]) - n[near])
            near = near[100 * both >= percent * (n[near] + n[x] - both)]
            a.append(node[near])
            b.append(np.full(len(near), node[x]))
    return np.concatenate(a), np.concatenate(b)


def _across(shared: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket and different components whose sets are similar.

    A bucket of more than ``BLOCK`` nodes is dealt to blocks, and each pair of blocks is a group.
    """
    least = _least_match(percent)
    members = shared.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    open_keys = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low < high")
    rows = members.join(open_keys.select("key", "blocks"), "key").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "component", "node").join(sets.select("node", "n", "sketch", "short"), "node")
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _similar(group, percent, least)], names=["a", "b"])
        for batch in batches:
            for k, i, j, *member in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "node", "component", "n", "sketch", "short")), strict=True):
                if (k, i, j) != key:
                    if len(group) > 1:
                        yield out()
                    key, group = (k, i, j), []
                group.append(tuple(member))
        if len(group) > 1:
            yield out()

    return rows.select("key", "i", "j", "node", "component", "n", "sketch", "short").mapInArrow(meet, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest doc_id reached over links) and ``kept``.

    One row per row of ``docs``. Two documents are linked if their sets have 100 * intersection >=
    percent * union. A null text is empty; a document without words is its own component. Rows that share
    a doc_id are one document, linked by any of their texts. A row without doc_id is linked with
    nothing: its component is null and it is kept. Very long texts count whole.
    """
    bands = bands_for(percent)
    signed = materialise(signatures(docs, words, bands), "signatures")
    usable = signed.where("set_key is not null and doc_id is not null")
    nodes = materialise(
        usable.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")),
        "nodes",
    )
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    hubs = buckets.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("far")).where("hub < far")
    shared = materialise(buckets.join(hubs.select("key", "hub"), "key"), "buckets")
    sets = materialise(candidate_sets(id_and_text(docs), shared.select("node").distinct(), words, bands), "sets")
    stars = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    first = materialise(confirm(materialise(_plausible(stars, sets, percent), "edges"), sets, percent), "links")
    across = materialise(_across(shared.select("key", "node"), components(first), sets, percent), "edges")
    second = materialise(confirm(across, sets, percent), "links")
    # a doc_id with texts of several classes links these classes
    owned = usable.join(nodes.select("set_key", "node"), "set_key").select("doc_id", "node")
    several = owned.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("doc_id")
    versions = owned.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = components(first.union(second).union(versions))
    placed = signed.select("doc_id", "n_shingles", "set_key").join(nodes.select("set_key", "node"), "set_key", "left").join(labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least("doc_id", F.coalesce("component", "node", "doc_id")))
    return placed.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
