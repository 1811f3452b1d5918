"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

The distance is that of unit vectors, so nearest is largest cosine. A node of a tree has a
vantage point and cuts the others at the median distance from it; what lies further from the query than
its worst neighbour so far, by the triangle inequality, is not visited. ``factor`` relaxes this: the
bound is multiplied by it before it is compared, so above 1 more is cut off and neighbours may be
missed; 1 is exact. A shard's tree is built once, stored, and meets the queries in batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import materialise

#: Vectors of a shard, queries that one part of a shard's queries has, and vectors of a leaf.
SHARD_ROWS, PART_QUERIES, LEAF = 8192, 4096, 128
#: Rounding that a distance may carry; it only makes the search visit more.
SLACK = 1e-7


def usable_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``row``, ``vec_id`` and ``vector`` (doubles) of the rows that take part, written in ranges of the id.

    Left out: a null id or vector, one with null or non-finite components, the zero vector, and vectors of
    another length than the commonest (the longer of equally common ones). Rows may share an id: ``row`` is
    each one's own, ascending with the id.
    """
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite)
    common = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kept = rows.where(F.size("vector") == (common["size"] if common else 0))
    width = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept.repartitionByRange(width, "vec_id", F.xxhash64("vector")).sortWithinPartitions("vec_id", "vector")
    return materialise(dealt.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector"), "vectors")


def _cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosine of each query and vector, sums taken component by component from the first one."""
    dot = np.zeros((len(queries), len(vectors)))
    for d in range(vectors.shape[1]):
        dot += queries[:, d, None] * vectors[:, d]
    return dot / (_norms(queries)[:, None] * _norms(vectors))


def _norms(vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        total += vectors[:, d] * vectors[:, d]
    return np.sqrt(total)


def _distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosines))


class Tree:
    """Distinct vectors in tree order, the ascending ids of each, and the nodes.

    A node is a row: start and end of its vectors, the places of its two children (-1: a leaf), and the least and
    largest distance of each child's vectors from the vantage point, which is the node's first vector.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, ends: np.ndarray, spans: np.ndarray, reach: np.ndarray):
        self.vectors, self.ids, self.ends, self.spans, self.reach = vectors, ids, ends, spans, reach

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray) -> Tree:
        order = np.lexsort((ids, *vectors.T[::-1]))
        ids, vectors = ids[order], vectors[order]
        new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(axis=1)))
        first = np.flatnonzero(new)
        copies = np.split(ids, first[1:])
        distinct = vectors[first]
        at = np.arange(len(distinct))
        rng = np.random.default_rng(len(distinct))
        spans, reach, todo = [[0, len(at), -1, -1]], [[0.0] * 4], [0]
        while todo:
            node = todo.pop()
            start, end = spans[node][:2]
            if end - start <= LEAF:
                continue
            pick = start + int(rng.integers(end - start))
            at[[start, pick]] = at[[pick, start]]
            rest = at[start + 1 : end]
            distance = _distances(_cosines(distinct[at[start]][None], distinct[rest])[0])
            by = np.argsort(distance, kind="stable")
            at[start + 1 : end], distance = rest[by], distance[by]
            half = len(by) // 2
            for k, (low, high) in enumerate(((0, half), (half, len(by)))):
                spans[node][2 + k] = len(spans)
                reach[node][2 * k : 2 * k + 2] = [float(distance[low]), float(distance[high - 1])]
                todo.append(len(spans))
                spans.append([start + 1 + low, start + 1 + high, -1, -1])
                reach.append([0.0] * 4)
        copies = [copies[i] for i in at]
        return cls(distinct[at], np.concatenate(copies), np.cumsum([len(c) for c in copies]), np.array(spans, np.int64), np.array(reach))

    def store(self) -> dict[str, bytes]:
        return {"vectors": self.vectors.tobytes(), "ids": self.ids.tobytes(), "ends": self.ends.tobytes(), "spans": self.spans.tobytes(), "reach": self.reach.tobytes()}

    @classmethod
    def load(cls, row: dict) -> Tree:
        ends = np.frombuffer(row["ends"], np.int64)
        vectors = np.frombuffer(row["vectors"]).reshape(len(ends), -1)
        return cls(vectors, np.frombuffer(row["ids"], np.int64), ends, np.frombuffer(row["spans"], np.int64).reshape(-1, 4), np.frombuffer(row["reach"]).reshape(-1, 4))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of each query's k nearest (score minus infinity where there are fewer), its own id left out."""
        ids, scores = np.full((len(queries), k), -1), np.full((len(queries), k), -np.inf)

        def meet(rows: np.ndarray, places: range) -> None:
            # of equal vectors only the first k + 1 ids can be among the nearest
            columns = [(p, i) for p in places for i in self.ids[self.ends[p - 1] if p else 0 : self.ends[p]][: k + 1].tolist()]
            found = _cosines(queries[rows], self.vectors[[p for p, _ in columns]])
            own = np.array([i for _, i in columns])
            found = np.where(own == query_ids[rows][:, None], -np.inf, found)
            better = (found >= scores[rows, -1:]).any(axis=1)
            rows, found = rows[better], found[better]
            if len(rows):
                both, who = np.hstack((scores[rows], found)), np.hstack((ids[rows], np.broadcast_to(own, found.shape)))
                best = np.lexsort((who, -both), axis=-1)[:, :k]
                scores[rows], ids[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(who, best, 1)

        def visit(node: int, rows: np.ndarray) -> None:
            start, end, inner, outer = self.spans[node].tolist()
            if inner < 0:
                return meet(rows, range(start, end))
            meet(rows, range(start, start + 1))
            distance = _distances(_cosines(queries[rows], self.vectors[start : start + 1])[:, 0])
            low = [np.maximum(np.maximum(distance - self.reach[node, 2 * c + 1], self.reach[node, 2 * c] - distance), 0) for c in (0, 1)]
            inside = low[0] <= low[1]
            for near in (True, False):  # each query goes to its nearer half first
                some = np.flatnonzero(inside == near)
                for c in (0, 1) if near else (1, 0):
                    left = some[factor * low[c][some] <= _distances(np.maximum(scores[rows[some], -1], -1.0)) + SLACK]
                    if len(left):
                        visit((inner, outer)[c], rows[left])

        if len(queries):
            visit(0, np.arange(len(queries)))
        return ids, scores


_STORED = "shard int, vectors binary, ids binary, ends binary, spans binary, reach binary"


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard: the tree of its vectors (``vec_id``, ``vector``), written to the shared folder."""
    shards = max(1, -(-vectors.count() // shard_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids, parts = None, [], []

        def out() -> pa.RecordBatch:
            tree = Tree.build(np.concatenate(ids), np.concatenate(parts))
            row = {"shard": shard, **tree.store()}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([("shard", pa.int32()), *((c, pa.binary()) for c in ("vectors", "ids", "ends", "spans", "reach"))]))

        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            for number in np.unique(numbers).tolist():
                if number != shard and ids:
                    yield out()
                    ids, parts = [], []
                shard, own = number, batch.filter(pa.array(numbers == number))
                ids.append(own.column("vec_id").to_numpy())
                parts.append(own.column("vector").flatten().to_numpy().reshape(own.num_rows, -1))
        if ids:
            yield out()

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return materialise(dealt.repartition(shards, "shard").sortWithinPartitions("shard").select("shard", "vec_id", "vector").mapInArrow(build, _STORED), "trees")


def nearest(index: DataFrame, queries: DataFrame, k: int = 5, factor: float = 1.0) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: each query's k nearest but itself, ties to the smaller id.

    Every shard gets the queries (``vec_id``, ``vector``) in parts of about ``PART_QUERIES``, each behind its own
    copy of the tree, so that a task holds one tree and one batch of queries. No queries or no vectors
    give no rows; fewer than k candidates give as many rows.
    """
    parts = max(1, -(-queries.count() // PART_QUERIES))
    names = [c.split()[0] for c in _STORED.split(", ")[1:]]
    none = lambda kind: F.lit(None).cast(kind)
    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("int")
    top = index.agg(F.max("shard")).first()[0] or 0
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(top))).alias("shard"), part.alias("part"), F.lit(1).alias("kind"), "vec_id", "vector").join(
        index.select("shard"), "shard", "left_semi"  # a shard that no vector fell into has no tree
    ).select("*", *[none("binary").alias(c) for c in names])
    trees = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("kind"), none("long").alias("vec_id"), none("array<double>").alias("vector"), *names)
    met = trees.union(asked).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "vec_id")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((kinds[1:] == 0) | (kinds[:-1] == 0)) + 1).tolist(), len(kinds)]
            for low, high in zip(cuts, cuts[1:]):
                some = batch.slice(low, high - low)
                if some.num_rows and kinds[low] == 0:
                    tree = Tree.load(some.to_pylist()[0])
                elif some.num_rows:
                    ids = some.column("vec_id").to_numpy()
                    found, scores = tree.search(ids, some.column("vector").flatten().to_numpy().reshape(len(ids), -1), k, factor)
                    there = np.isfinite(scores)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, there.sum(axis=1))), pa.array(found[there]), pa.array(scores[there])], names=["query_id", "vec_id", "score"])

    hits = met.mapInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(table: DataFrame, is_query, k: int = 5, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Index all usable vectors and search those for which the column ``is_query`` (over ``vec_id``) holds.

    Rows that share an id are candidates, and queries, each on its own: a query leaves out its own row alone.
    """
    rows = usable_vectors(table, id_col, vector_col)
    named = lambda df: df.select(F.col("row").alias("vec_id"), "vector")
    found = nearest(build_index(named(rows)), named(rows.where(is_query)), k, factor)
    ids = lambda key, name: rows.select(F.col("row").alias(key), F.col("vec_id").alias(name))
    out = found.withColumnsRenamed({"query_id": "query_row", "vec_id": "row"}).join(ids("query_row", "query_id"), "query_row").join(ids("row", "vec_id"), "row")
    return out.select("query_id", "rank", "vec_id", "score")
