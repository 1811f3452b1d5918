"""Text quality by compression against dictionaries of good and bad text.

Two zstandard dictionaries are built from labelled documents, one from good and one from bad ones.
A text is compressed with each, in pieces so small that a dictionary matters more than the text
itself; what good text helps less than bad text is bad. The difference of the compressed sizes,
divided by their sum, is the normalised difference. A logistic curve, fitted on labelled documents that
no dictionary holds, turns it into a probability; besides it the curve sees how far the text
compresses at all, and how much text there is to judge by.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import id_and_text, materialise, slices


def held_out(id_col: str = "doc_id") -> Column:
    """The fold whose labels are not to be learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries and the logistic curve; ``prior`` scores texts that say nothing."""

    good: bytes
    bad: bytes
    center: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5
    piece: int = 1024

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text the normalised difference (above 0 if good text helps more), the same by the amount of text, and
        the logarithm of the compression ratio, where it is strong and where it is weak."""
        import zstandard

        coders = []
        for content in (self.good, self.bad):
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=3)
            coders.append(zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=False, write_checksum=False))
        found = np.empty((len(texts), 4))
        for i, text in enumerate(texts):
            raw = text.encode()
            pieces = [raw[at : at + self.piece] for at in range(0, max(1, len(raw)), self.piece)]
            good, bad = (sum(len(coder.compress(p)) for p in pieces) for coder in coders)
            difference, ratio, amount = (bad - good) / (bad + good), np.log(min(good, bad) / (len(raw) + 1)), min(1.0, len(raw) / 400)
            found[i] = difference, amount * difference, np.clip(ratio, -4.0, -1.2), amount * np.clip(ratio, -1.2, -0.4)
        return found

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts or not self.weights:
            return np.full(len(texts), self.prior)
        blank = np.array([not t.strip() for t in texts])
        x = (self.features(texts) - self.center) / self.scale
        z = np.clip(np.column_stack((x, np.ones(len(x)))) @ np.array(self.weights), -30, 30)
        return np.where(blank, self.prior, 1 / (1 + np.exp(-z)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of the likeliest logistic curve of standardised features, the last one the offset (Newton's method)."""
    design = np.column_stack((x, np.ones(len(x))))
    ridge = np.array([penalty] * x.shape[1] + [1e-9])
    w = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design.T * (p * (1 - p))) @ design + np.diag(ridge), design.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def spread_pieces(text: str, size: int, piece: int = 256) -> bytes:
    """About ``size`` bytes of a text: all of it, or pieces at even distances from its first byte to its last."""
    raw = text.encode()
    if len(raw) <= size:
        return raw
    n = max(2, size // piece)
    starts = [(len(raw) - size // n) * i // (n - 1) for i in range(n)]
    return b"".join(raw[at : at + size // n] for at in starts)


def fit_curve(good: bytes, bad: bytes, x: np.ndarray, y: np.ndarray, odds: float | None = None) -> QualityModel:
    """A model with the given dictionaries and the curve for features ``x`` of texts labelled ``y``.

    ``odds`` are those of good to bad among all labels, if the texts are a sample of other proportions.
    """
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _logistic((x - center) / scale, y)
    if odds:
        weights[-1] += np.log(odds * (len(y) - y.sum()) / y.sum())
    return QualityModel(good, bad, tuple(center), tuple(scale), tuple(weights))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[DataFrame, dict[int, int]]:
    """The labelled texts to learn from (``quality``, ``place`` in the class, ``text``) and how many of each class there are.

    Of each class the ``sample`` documents whose id has the smallest digest.
    """
    known = labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.avg("quality").alias("share")).where("share <> 0.5").select("doc_id", (F.col("share") > 0.5).cast("int").alias("quality"), F.xxhash64("doc_id").alias("rank"))
    texts = id_and_text(docs).where(F.length(F.trim("text")) > 0).withColumn("digest", F.xxhash64("text"))
    first = texts.select("doc_id", "digest").join(known, "doc_id").groupBy("digest").agg(F.min(F.struct("rank", "doc_id", "quality")).alias("first"))
    there = materialise(first.select("first.*", "digest"), "labelled")
    count = {r["quality"]: r["count"] for r in there.groupBy("quality").count().collect()}
    picked = []
    for q in (0, 1):
        rows = there.where(F.col("quality") == q).orderBy("rank", "doc_id", "digest").limit(sample).collect()  # ids of the bounded sample
        picked += [(r["doc_id"], r["digest"], q, place) for place, r in enumerate(rows)]
    ids = docs.sparkSession.createDataFrame(picked, "doc_id long, digest long, quality int, place int")
    found = texts.join(F.broadcast(ids), ["doc_id", "digest"]).groupBy("quality", "place").agg(F.min("text").alias("text"))
    return materialise(found, "sample"), count


def learn_quality(docs: DataFrame, labels: DataFrame, sample: int = 2000, dictionary_bytes: int = 1 << 20, text_bytes: int = 1536) -> QualityModel:
    """Fit on documents with ``labels.quality`` 1 or 0 that is not held out.

    The sample is bounded in rows: of each class the ``sample`` documents whose id has the smallest digest. Every
    other one is for its class's dictionary, the rest, as whole texts, for the curve. A dictionary of at most ``dictionary_bytes``
    has an equal share of each of its texts, at most ``text_bytes``, in pieces from all over the text. Repeated labels
    of a document are averaged, and 0.5 counts as none. Blank texts and labels without a document are left out,
    equal texts count once. With a class missing every text scores the share of good ones (0.5 without any). Texts stay on
    the executors; the driver gets the dictionaries' pieces and four numbers for each text of the curve.
    """
    found, count = labelled_sample(docs, labels, sample)
    if len(count) < 2:
        return QualityModel(b"", b"", prior=float(next(iter(count), 0.5)))
    sizes = {q: min(n, sample) for q, n in count.items()}
    share = {q: min(text_bytes, dictionary_bytes // -(-n // 2)) for q, n in sizes.items()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            parts = [spread_pieces(t, share[q]) for q, t in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("place"), pa.array(parts, pa.binary())], names=["quality", "place", "part"])

    rows = found.where("place % 2 = 0").mapInArrow(cut, "quality int, place int, part binary").collect()  # at most two dictionaries
    # what comes last is nearest, and so cheapest to refer to
    good, bad = (b"\n".join(bytes(r["part"]) for r in sorted(rows, key=lambda r: -r["place"]) if r["quality"] == q) for q in (1, 0))
    bare = docs.sparkSession.sparkContext.broadcast(QualityModel(good, bad))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = bare.value.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("place"), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "place", "x"])

    # too few to keep some apart: all fit the curve
    apart = found.where("place % 2 = 1") if min(sizes.values()) > 1 else found
    rows = sorted(apart.mapInArrow(measure, "quality int, place int, x array<double>").collect(), key=lambda r: (-r["quality"], r["place"]))
    return fit_curve(good, bad, np.array([r["x"] for r in rows]), np.array([float(r["quality"]) for r in rows]), count[1] / count[0])


def quality_score(text: Column, model: QualityModel, spark: SparkSession) -> Column:
    """The score of a text column. Whole texts are compressed; a null or blank text scores the model's prior."""
    shared = spark.sparkContext.broadcast(model)  # two dictionaries of bounded size

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(shared.value.scores([t or "" for t in batch.to_pylist()]), pa.float64())

    return score(text)
