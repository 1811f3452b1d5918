"""A training corpus from raw documents, in four stages.

Documents that the quality classifier rejects go; of each group of near-duplicates one stays; secrets are
replaced in the texts; what is left is packed into sequences. Each stage but the last returns the
columns of its input. ``run`` writes every stage's result below the shared folder and reads it again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import materialise, prepare
from corpusflow.llm.minhash import near_duplicates
from corpusflow.llm.packing import pack_documents
from corpusflow.llm.quality import learn_quality, quality_score
from corpusflow.llm.secrets import redacted, secret_spans


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have yet."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of at least 0.5 by the model learned from ``labels`` (without the held-out third).

    Null and blank texts score the model's prior, 0.5 with labels of both classes, and stay.
    """
    prepare(spark)
    model = learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = _free(docs, "score")
    return docs.withColumn(name, quality_score(F.col("text"), model, spark)).where(F.col(name) >= 0.5).drop(name)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of their five-word shingles: the smallest doc_id.

    Empty documents and rows without doc_id are nobody's copies and stay. Of several rows with the doc_id
    that stays, the one whose text has the smallest digest stays.
    """
    prepare(spark)
    kept = near_duplicates(docs, percent=80).where("kept and doc_id is not null").select("doc_id").distinct()
    whole, tie = _free(docs, "row"), F.xxhash64("text")
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), tie).alias(whole))
    return one.select([F.col(whole)[c].alias(c) for c in docs.columns]).union(docs.where("doc_id is null"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts become ``[kind]``; ``n_chars`` follows. Texts without secrets stay as they are."""
    prepare(spark)
    name = _free(docs, "spans")
    clean = docs.withColumn(name, secret_spans(F.col("text"))).withColumn("text", redacted(F.col("text"), F.col(name)))
    if "n_chars" in docs.columns:
        changed = F.when(F.size(name) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        clean = clean.withColumn("n_chars", changed)
    return clean.select([F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences, one row per piece."""
    prepare(spark)
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("packing", packing)]

#: Compression, MinHash, automata and tokenizers can't be said in SQL; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
