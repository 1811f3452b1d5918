"""Vector search: exact and by cells, plus vector preparation."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from corpusflow import rules
from corpusflow.functions.basic import let, nullif_blank
from corpusflow.functions.text import sanitize, snippet
from corpusflow.session import scratch_dir

#: Queries and bytes of their vectors that every task gets as a copy; more are dealt out.
QUERY_BLOCK, QUERY_BYTES = 4096, 64 * 1024 * 1024
#: Scores held at once by a task (32 MB): batches are cut to stay below it.
MAX_SCORES = 4_000_000
#: Vectors that one part holds where queries are dealt out.
PART_ROWS = 20_000
#: Rounding that a matrix product may carry; candidates this close are scored exactly.
SLACK = 1e-9


def vector_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit_vector(v: Column) -> Column:
    """Scaled to length one; a zero vector stays as it is."""
    scale = F.when(vector_norm(v) > 0, 1 / vector_norm(v)).otherwise(F.lit(1.0))
    return let(scale, lambda s: F.transform(v, lambda x: x.cast("double") * s))


def has_dimension(v: Column, dim: int) -> Column:
    return F.size(v) == dim


def usable(v: Column, dim: int | None = None) -> Column:
    """Whether a vector can be compared: no nulls, every component finite, not zero, of ``dim`` components."""
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.coalesce(fine if dim is None else fine & has_dimension(v, dim), F.lit(False))


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


class _Best:
    """The ``k`` best ids of each query so far, by score in full precision, then by id."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.unit, self.k = queries, _unit_rows(queries), k
        self.norms = np.sqrt((queries * queries).sum(axis=1))
        self.found: list[list[tuple]] = [[] for _ in queries]
        self.worst = np.full(len(queries), -np.inf)

    def offer(self, ids: list, vectors: np.ndarray) -> None:
        if not len(self.queries):
            return
        unit, norms = _unit_rows(vectors), np.sqrt((vectors * vectors).sum(axis=1))
        step = max(1, MAX_SCORES // len(self.queries))
        for at in range(0, len(ids), step):
            near = self.unit @ unit[at : at + step].T
            edge = np.maximum(self.worst, -np.partition(-near, self.k - 1, axis=1)[:, self.k - 1] if near.shape[1] > self.k else -np.inf)
            for q in np.flatnonzero((near >= edge[:, None] - SLACK).any(axis=1)):
                some = np.flatnonzero(near[q] >= edge[q] - SLACK) + at
                # row by row, so that equal vectors score equal wherever they stand
                exact = (vectors[some] * self.queries[q]).sum(axis=1) / (norms[some] * self.norms[q])
                self.found[q] = heapq.nsmallest(self.k, self.found[q] + [(-s, ids[i]) for s, i in zip(exact.tolist(), some.tolist())])
                if len(self.found[q]) == self.k:
                    self.worst[q] = -self.found[q][-1][0]

    def rows(self) -> list[tuple[int, object, float]]:
        return [(q, i, -s) for q, hits in enumerate(self.found) for s, i in hits]


def _dealt(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(_q, _v, score)`` candidates where vectors ``(part, salt, _v, vec)`` and queries ``(part, salt, _q, vec)`` meet.

    Both are shuffled on (part, salt); a task holds one part's vectors and reads its queries in batches.
    """
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = vectors.select("part", "salt", F.lit(0).alias("kind"), none(queries, "_q"), "_v", "vec").union(
        queries.select("part", "salt", F.lit(1), "_q", none(vectors, "_v"), "vec")
    )
    met = both.repartition("part", "salt").sortWithinPartitions("part", "salt", "kind")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, parts = None, [], []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("part", "salt", "kind"))))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                some = batch.slice(low, high - low)
                if keys[low][:2] != group:
                    group, ids, parts = keys[low][:2], [], []
                if keys[low][2] == 0:
                    ids += some.column("_v").to_pylist()
                    parts.append(_matrix(some.column("vec")))
                elif ids:
                    parts = [np.concatenate(parts)]
                    asked = _Best(_matrix(some.column("vec")), k)
                    asked.offer(ids, parts[0])
                    rows = asked.rows()
                    yield pa.RecordBatch.from_arrays(
                        [some.column("_q").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], some.column("_v").type), pa.array([r[2] for r in rows], pa.float64())],
                        names=["_q", "_v", "score"],
                    )

    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "_q"), (vectors, "_v"))]
    return met.mapInArrow(best, ", ".join([*kinds, "score double"]))


def _copied(vectors: DataFrame, block: list, k: int, id_type: DataType) -> DataFrame:
    """The same candidates where every task has a copy of the few queries: one scan, and no shuffle of vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast([(q, [float(x) for x in v]) for q, v in block])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [q for q, _ in shared.value]
        asked = _Best(np.array([v for _, v in shared.value], np.float64), k)
        kind, q_kind = None, to_arrow_type(id_type)
        for batch in batches:
            kind = batch.column("_v").type
            asked.offer(batch.column("_v").to_pylist(), _matrix(batch.column("vec")))
        if kind is not None and (rows := asked.rows()):
            yield pa.RecordBatch.from_arrays([pa.array([names[r[0]] for r in rows], q_kind), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64())], names=["_q", "_v", "score"])

    return vectors.select("_v", "vec").mapInArrow(best, f"_q {id_type.simpleString()}, _v {vectors.schema['_v'].dataType.simpleString()}, score double")


def _ranked(hits: DataFrame, k: int, query_id: str, vec_id: str) -> DataFrame:
    """Ranks by full precision; the score is rounded last."""
    w = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc("_v"))
    best = hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(F.col("_q").alias(query_id), F.col("_v").alias(vec_id), F.round("score", 4).alias("score"), "rank")


def _ready(df: DataFrame, id_col: str, vector: str, name: str, dim: int | None) -> DataFrame:
    return df.where(F.col(id_col).isNotNull() & usable(F.col(vector), dim)).select(F.col(id_col).alias(name), F.col(vector).cast("array<double>").alias("vec"))


def cosine_top_k(
    vectors: DataFrame, queries: DataFrame, k: int = rules.TOP_K, query_id: str = "query_id",
    query_vector: str = "query_vector", vec_id: str = "vec_id", vector: str = "embedding",
    min_score: float | None = None, copied: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact search: ``(query_id, vec_id, score, rank)``; ranked by cosine in full
    precision, equal ones by id, then rounded to four places.

    Ids may be numbers or text. Vectors and queries that are null, zero, not finite or of another length than the
    first query take no part (``usable`` finds them). Up to ``copied`` queries of a checked size go to
    every task and vectors are only scanned; the hits, at most that many times ``k``, are then marked as small
    enough to broadcast. More queries are dealt out to parts of the vectors, each read once. Filters
    belong on ``vectors`` before the call, where they reach the scan.
    """
    asked = _ready(queries, query_id, query_vector, "_q", None)
    block = asked.limit(copied + 1).collect()
    if not block:
        kinds = vectors.schema[vec_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"`{query_id}` {kinds[1]}, `{vec_id}` {kinds[0]}, score double, rank int")
    dim = len(block[0]["vec"])
    ready = _ready(vectors, vec_id, vector, "_v", dim)
    if len(block) <= copied and 8 * dim * len(block) <= QUERY_BYTES:
        block = [(r["_q"], r["vec"]) for r in block if len(r["vec"]) == dim]
        hits = _ranked(_copied(ready, block, k, asked.schema["_q"].dataType), k, query_id, vec_id).hint("broadcast")
    else:
        parts = max(1, -(-ready.count() // PART_ROWS))
        salted = ready.select(F.lit(0).alias("part"), F.pmod(F.xxhash64("_v"), F.lit(parts)).cast("int").alias("salt"), "_v", "vec")
        everywhere = asked.where(F.size("vec") == dim).select(F.lit(0).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("salt"), "_q", "vec")
        hits = _ranked(_dealt(salted, everywhere, k), k, query_id, vec_id)
    return hits if min_score is None else hits.where(F.col("score") >= min_score)


def cells_of(vectors: np.ndarray, centres: np.ndarray, spill: float | None) -> list[list[int]]:
    """The cells each vector is stored in: the nearest one and, with ``spill``, a second one.

    What the nearest centre leaves of a vector, its residual, makes it hard to find for queries that lie along it. The second
    cell's own residual should point elsewhere: its share along the first residual costs ``spill`` times its square more.
    """
    unit = _unit_rows(vectors)
    near = unit @ centres.T
    first = near.argmax(axis=1)
    if spill is None or len(centres) < 2:
        return [[c] for c in first.tolist()]
    rest = _unit_rows(unit - centres[first] * near[np.arange(len(unit)), first][:, None])
    along = (unit * rest).sum(axis=1)[:, None] - rest @ centres.T
    cost = 2 - 2 * near + spill * along * along
    cost[np.arange(len(unit)), first] = np.inf
    return np.column_stack((first, cost.argmin(axis=1))).tolist()


class CellIndex:
    """Vectors stored by k-means cell, each in two cells; a search reads only the cells it probes.

    A cell is stored in parts of about ``PART_ROWS`` vectors, so a crowded cell is many parts. ``sizes`` are
    the cells' stored rows.
    """

    def __init__(self, path: str, centres: np.ndarray, sizes: np.ndarray, vec_id: str):
        self.path, self.centres, self.sizes, self.vec_id = path, centres, sizes, vec_id

    @classmethod
    def build(cls, vectors: DataFrame, lists: int = rules.IVF_LISTS, vec_id: str = "vec_id", vector: str = "embedding", seed: int = 7,
              path: str | None = None, iterations: int = 10, spill: float | None = 1.0) -> CellIndex:
        """Every usable vector is stored, and the cell centres are learned from all of them. Without ``spill`` a vector has one cell."""
        path = path or scratch_dir(vectors.sparkSession, "cells")
        common = vectors.where(usable(F.col(vector))).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
        ready = _ready(vectors, vec_id, vector, "_v", common["n"] if common else 0)
        features = ready.withColumn("_f", array_to_vector(unit_vector(F.col("vec")))).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            model = KMeans(
                k=lists, seed=seed, maxIter=iterations, distanceMeasure="cosine", featuresCol="_f", predictionCol="part"
            ).fit(features)
            centres = _unit_rows(np.array(model.clusterCenters()))

            def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        cells = pa.array(cells_of(_matrix(batch.column("vec")), centres, spill), pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([cells, batch.column("_v"), batch.column("vec")], names=["cells", "_v", "vec"])

            kind = ready.schema["_v"].dataType.simpleString()
            placed = features.select("_v", "vec").mapInArrow(place, f"cells array<int>, _v {kind}, vec array<double>").select(F.explode("cells").alias("part"), "_v", "vec")
            counted = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}  # a row for each cell
            sizes = np.array([counted.get(c, 0) for c in range(len(centres))], np.int64)
            salts = F.get(F.array(*[F.lit(max(1, -(-int(n) // PART_ROWS))) for n in sizes]), F.col("part"))
            salted = placed.withColumn("salt", F.pmod(F.xxhash64("_v"), salts).cast("int"))
            salted.repartition("part", "salt").write.partitionBy("part").parquet(path)
        finally:
            features.unpersist()
        return cls(path, centres, sizes, vec_id)

    def _probed(self, queries: DataFrame, probes: int | None, share: float | None, query_id: str, query_vector: str) -> DataFrame:
        """(``part``, ``_q``, ``vec``, ``rows``): the cells of each query, nearest first, as many as ``probes`` or as have
        ``share`` of the stored rows together, one at least."""
        centres, sizes = self.centres, self.sizes
        most = sizes.sum() if share is None else max(share * sizes.sum(), 1)
        asked = _ready(queries, query_id, query_vector, "_q", centres.shape[1])

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order = np.argsort(-(_unit_rows(_matrix(batch.column("vec"))) @ centres.T), axis=1, kind="stable")[:, :probes]
                kept = np.cumsum(sizes[order], axis=1) <= most
                kept[:, :1] = True
                rows, columns = np.nonzero(kept)
                cells, at = order[rows, columns], pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells, pa.int32()), batch.column("_q").take(at), batch.column("vec").take(at), pa.array(sizes[cells])], names=["part", "_q", "vec", "rows"]
                )

        return asked.mapInArrow(probe, f"part int, _q {asked.schema['_q'].dataType.simpleString()}, vec array<double>, rows long")

    def rows_read(self, queries: DataFrame, probes: int | None = None, share: float | None = None, query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
        """For each query the stored rows that its search compares it with, and their share of all."""
        read = self._probed(queries, probes, share, query_id, query_vector).groupBy(F.col("_q").alias(query_id)).agg(F.sum("rows").alias("rows"))
        return read.withColumn("share", F.col("rows") / F.lit(int(self.sizes.sum())))

    def search(self, spark, queries: DataFrame, k: int = rules.TOP_K, probes: int | None = None, share: float | None = None, query_id: str = "query_id",
               query_vector: str = "query_vector") -> DataFrame:
        """Any number of queries: each goes to the parts of its nearest cells, ``probes`` of them or as many as hold ``share`` of
        the stored rows. A vector that two of them hold is found once."""
        stored = spark.read.parquet(self.path)
        probed = self._probed(queries, probes, share, query_id, query_vector)
        parts = stored.select("part", "salt").distinct()  # a row for each part
        cells = [r["part"] for r in probed.select("part").distinct().collect()]  # at most as many as cells
        hits = _dealt(stored.where(F.col("part").isin(cells)), probed.join(F.broadcast(parts), "part").select("part", "salt", "_q", "vec"), k)
        return _ranked(hits.groupBy("_q", "_v").agg(F.max("score").alias("score")), k, query_id, self.vec_id)


def recall_at_k(found: DataFrame, exact: DataFrame, query_id: str = "query_id", vec_id: str = "vec_id") -> DataFrame:
    """Share of the exact hits that were found, per query."""
    marked = found.select(query_id, vec_id).withColumn("_hit", F.lit(1))
    return exact.join(marked, [query_id, vec_id], "left").groupBy(query_id).agg(
        F.avg(F.coalesce("_hit", F.lit(0))).alias("recall")
    )


def hashed_vectors(df: DataFrame, text: str, dim: int = rules.VECTOR_DIM, out: str = "embedding") -> DataFrame:
    """Hashed term counts scaled to unit length: the default vectoriser.

    ``vectoriser`` names it, so that corpus and queries can be checked to have
    used the same one.
    """
    stages = [
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=r"\W+", minTokenLength=1),
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim),
        Normalizer(inputCol="_tf", outputCol="_unit", p=2.0),
    ]
    filled = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    made = Pipeline(stages=stages).fit(filled).transform(filled)
    return made.withColumns(
        {out: vector_to_array("_unit", "float32"), "vectoriser": F.lit(f"hashed-tf-l2-{dim}")}
    ).drop("_tokens", "_tf", "_unit")


def map_hits(hits: DataFrame, default_category: str = rules.DEFAULT_CATEGORY) -> DataFrame:
    """Raw search hits ``(title, concept, source_url, page, text, score)`` to
    display form: safe text, page in the title, http links only."""
    title = sanitize(F.coalesce(nullif_blank(F.col("title")), F.lit("Untitled document")))
    paged = F.when(F.col("page") > 0, F.concat(title, F.lit(", p. "), F.floor("page").cast("string"))).otherwise(title)
    others = [c for c in hits.columns if c not in ("title", "concept", "source_url", "page", "text", "score")]
    return hits.withColumn("content", sanitize(F.coalesce("text", F.lit("")))).select(
        *others,
        paged.alias("title"),
        snippet("content").alias("snippet"),
        "content",
        sanitize(F.coalesce(nullif_blank(F.col("concept")), F.lit(default_category))).alias("category"),
        F.when(F.col("source_url").rlike("^https?://"), F.col("source_url")).alias("source_url"),
        F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"),
    )
