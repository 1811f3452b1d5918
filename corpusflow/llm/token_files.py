"""Token ids in flat binary files: unsigned integers end to end, 64-bit document offsets beside them.

A data set is a folder of shards in ascending order of the documents' ids. Shard ``n`` is three
files: ``shard-n.tok`` (little-endian unsigned integers of 2 bytes if the vocabulary allows, else 4),
``shard-n.off`` (signed 64-bit, one more than it has documents: where each document begins in the
shard) and ``shard-n.doc`` (signed 64-bit document ids; ``NULL_ID`` stands for null). A reader maps
them into memory. The manifest names each shard's documents and tokens; running sums over it are the
shards' bases, so a document's place in the whole data set is its shard's base and its own offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm.common import attempt_name, filesystem, gathered, id_and_text, write_once
from corpusflow.llm.tokens import encoder as shared_encoder
from corpusflow.session import scratch_dir

NULL_ID = -(2**63)


@dataclass(frozen=True)
class Shard:
    path: str
    width: int
    documents: int
    tokens: int
    base: int


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shards: int | None = None) -> list[Shard]:
    """Encode the documents, append ``end_id`` to each and write the shards; returns the manifest, one entry a shard.

    Documents are dealt to shards by ranges of (doc_id, digest of the text, place in the input), so
    that even a doc_id that many rows share is spread over shards. A null text is an empty
    one, a null doc_id comes first, and rows with equal doc_id stand in order of their texts' digest.
    An empty table has no shard.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, attempt, encoder = TaskContext.get().partitionId(), attempt_name(), shared_encoder(tokenizer)
        name = f"{folder}/shard-{number:05d}"
        ids, lengths = [], []

        def fill(out) -> None:
            end = np.array([end_id], f"<u{encoder.width}").tobytes()
            for batch in gathered(batches):
                ids.extend(NULL_ID if x is None else x for x in batch.column("doc_id").to_pylist())
                for found in encoder.encode(batch.column("text")):
                    out.write(found)
                    out.write(end)
                    lengths.append(len(found) // encoder.width + 1)

        write_once(f"{name}.tok", attempt, fill)
        if ids:
            offsets = np.concatenate(([0], np.cumsum(lengths))).astype("<i8")
            write_once(f"{name}.off", attempt, lambda out: out.write(offsets.tobytes()))
            write_once(f"{name}.doc", attempt, lambda out: out.write(np.array(ids, "<i8").tobytes()))
            row = {"shard": [number], "path": [name], "width": [encoder.width], "documents": [len(ids)], "tokens": [int(offsets[-1])]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), ("width", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())]))

    keyed = id_and_text(docs).withColumns({"digest": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("place")]
    written = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(write, "shard int, path string, width int, documents long, tokens long")
    rows = sorted(written.collect(), key=lambda r: r["shard"])  # a row for each shard
    bases = accumulate((r["tokens"] for r in rows), initial=0)
    return [Shard(r["path"], r["width"], r["documents"], r["tokens"], base) for r, base in zip(rows, bases)]


def _mapped(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped into memory where the folder is mounted, read otherwise."""
    from pyarrow import fs

    system, path = filesystem(uri)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with system.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype)


def read_token_files(spark: SparkSession, manifest: list[Shard], with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``start`` (ids before it in the whole data set), ``n_tokens``, ``ids_crc32`` (of the ids as
    little-endian unsigned 32-bit integers) and, if wanted, ``ids``; a task for each shard."""
    names = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"
    if not manifest:
        return spark.createDataFrame([], names)
    shards = spark.createDataFrame([(s.path, s.width, s.base) for s in manifest], "path string, width int, base long").repartition(len(manifest), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, width, base in (tuple(r.values()) for b in batches for r in b.to_pylist()):
            offsets, ids = _mapped(f"{path}.off", "<i8"), _mapped(f"{path}.doc", "<i8")
            tokens = _mapped(f"{path}.tok", f"<u{width}")
            for at in range(0, len(ids), 256):
                to = min(at + 256, len(ids))
                own = [np.asarray(tokens[offsets[i] : offsets[i + 1]]) for i in range(at, to)]
                doc_ids = np.asarray(ids[at:to])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids, mask=doc_ids == NULL_ID),
                        pa.array(offsets[at:to] + base),
                        pa.array(np.diff(offsets[at : to + 1])),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64()),
                        pa.array([x.astype("i8") if with_ids else None for x in own], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    out = shards.mapInArrow(read, names)
    return out if with_ids else out.drop("ids")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """Write the documents below the shared folder and read the files back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, tokenizer, end_id, scratch_dir(spark, "tokens")), with_ids)
