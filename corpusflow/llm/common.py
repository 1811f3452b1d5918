"""What several operators of this subpackage share: input columns, task settings, shared files."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.session import prepare as prepare_session
from corpusflow.session import scratch_dir

#: Rows handed to a Python task at once; texts may be long, so few of them, and of few bytes (but for single rows).
BATCH_ROWS, BATCH_BYTES = "512", "4m"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the library, with Arrow batches small enough for whole texts."""
    spark = prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) alone, so other columns can't clash with an operator's own."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write a frame below the shared folder and read it back, so that a lost executor costs no recomputation."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_table(kept: bytes) -> bytes:
    """A translation of UTF-8 bytes that lower-cases A-Z, keeps ``kept`` and all beyond ASCII, and makes the rest blanks."""
    return bytes(b if (b := i + 32 if 65 <= i <= 90 else i) in kept or b >= 128 else 32 for i in range(256))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 4 << 20, by: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices of at most ``rows`` rows and, but for single rows, about ``size`` bytes of ``by``."""
    for batch in batches:
        column = batch.column(by)
        column = column.cast(pa.large_binary()) if pa.types.is_string(column.type) else column
        lengths = column.fill_null(b"").to_pylist() if pa.types.is_large_binary(column.type) else [b""] * batch.num_rows
        at = held = 0
        for i, value in enumerate(lengths):
            if i > at and (i - at >= rows or held + len(value) > size):
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += len(value)
        if at < batch.num_rows:
            yield batch.slice(at)


def gathered(batches: Iterator[pa.RecordBatch], size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """The rows in record batches of about ``size`` bytes, or of one row where that is larger."""
    held, bytes_held = [], 0
    for batch in slices(batches, rows=1 << 30, size=size):
        if held and bytes_held + batch.nbytes > size:
            yield pa.concat_batches(held)
            held, bytes_held = [], 0
        held.append(batch)
        bytes_held += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def filesystem(uri: str):
    """The Arrow file system of a shared folder, and the path in it."""
    from pyarrow import fs

    if urlsplit(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlsplit(uri).path
    return fs.FileSystem.from_uri(uri)


def write_once(uri: str, attempt: str, writer) -> None:
    """Let ``writer(stream)`` fill a file; it gets its name when it is whole, so that a task that
    is run again, or twice at a time, never leaves part of a file."""
    system, path = filesystem(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.{attempt}"
    with system.open_output_stream(part) as out:
        writer(out)
    system.move(part, path)


def attempt_name() -> str:
    """A name for this attempt of this task."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.stageId()}-{context.partitionId()}-{context.attemptNumber()}.part" if context else "driver.part"
