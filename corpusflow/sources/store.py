"""A table in hash buckets of its key, with versions: a change reads and writes only the buckets it touches.

Rows lie below ``data/version=V/bucket=B``. A part is one bucket's folder of one version; the manifest of a version names the
parts that are the table then, so readers of an older version aren't disturbed and a write that fails leaves
nothing visible. Upserts and removals write a touched bucket anew; additions add a part, and a bucket with ``most_parts``
is written as one. Each part has a Bloom filter of its keys, so keys that are new are known to be so without a
look at the stored rows. One writer at a time; folders of older versions stay until somebody removes them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from corpusflow.session import materialise

MANIFEST = "bucket int, part long, rows long, commit long"
BLOOM = "bucket int, part long, bits binary"
#: Bits for each key, and places of a key among them: about one new key in a hundred looks known.
BITS, PLACES = 10, 7


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The places of 64-bit hashes in a filter of ``size`` bits, a row for each hash."""
    low, high = hashes.view(np.uint64) & np.uint64(0xFFFFFFFF), hashes.view(np.uint64) >> np.uint64(32)
    return (low[:, None] + np.arange(PLACES, dtype=np.uint64) * (high[:, None] | np.uint64(1))) % np.uint64(size)


def bloom_bits(hashes: np.ndarray) -> bytes:
    held = np.zeros(-(-max(64, BITS * len(hashes)) // 8) * 8, bool)
    held[_places(hashes, len(held)).ravel()] = True
    return np.packbits(held).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    held = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
    return held[_places(hashes, len(held))].all(axis=1)


class KeyedStore:
    """Rows of ``schema`` (a DDL string or a type) with one row for each ``key``, below ``path``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | StructType, buckets: int = 64, most_parts: int = 8):
        self.spark, self.path, self.key, self.buckets, self.most_parts = spark, path.rstrip("/"), key, buckets, most_parts
        self.schema = spark.createDataFrame([], schema).schema

    def _hash(self):
        return F.xxhash64(F.col(f"`{self.key}`").cast("string"))

    def _in_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(self._hash(), F.lit(self.buckets)).cast("int"))

    def _touched(self, rows: DataFrame) -> list[int]:
        """Numbers of the buckets that the rows fall into, at most ``buckets``."""
        return sorted(r["bucket"] for r in self._in_bucket(rows).select("bucket").distinct().collect())

    def version(self) -> int:
        """The newest version, 0 before the first write."""
        try:
            files = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest").inputFiles()
        except AnalysisException:
            return 0
        return max((int(v) for f in files for v in re.findall(r"/version=(\d+)/", f)), default=0)

    def parts(self, version: int | None = None) -> list[tuple[int, int, int, int | None]]:
        """(bucket, part, rows, commit) of a version; at most ``buckets`` times ``most_parts``."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/version={version}").collect()
        return sorted(tuple(r) for r in rows)

    def last_commit(self) -> int | None:
        """The highest number given to a write."""
        return max((c for _, _, _, c in self.parts() if c is not None), default=None)

    def read(self, buckets: Sequence[int] | None = None, version: int | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        wanted = None if buckets is None else set(buckets)
        folders = [f"{self.path}/data/version={part}/bucket={b}" for b, part, rows, _ in self.parts(version) if rows and (wanted is None or b in wanted)]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def written(self, commit: int) -> DataFrame:
        """The rows of the parts that the write of this number made, which may hold older rows of full buckets."""
        folders = [f"{self.path}/data/version={part}/bucket={b}" for b, part, rows, c in self.parts() if rows and c == commit]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, replaced: Sequence[int], commit: int | None) -> None:
        """A new version: ``rows`` in parts of their own, in place of the ``replaced`` buckets' parts."""
        number, old = self.version() + 1, self.parts()
        folder, gone = f"{self.path}/data/version={number}", set(replaced)
        dealt = self._in_bucket(rows.select(*[F.col(f"`{f.name}`") for f in self.schema]))
        # a few tasks for a bucket, by the key's hash, so that buckets may be larger than a task
        dealt.repartition("bucket", F.pmod(F.xxhash64(self._hash()), F.lit(4))).write.mode("overwrite").partitionBy("bucket").parquet(folder)
        written = self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(folder).select("bucket", self._hash().alias("hash"))

        def bloom(key, keys):
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "part": [number], "bits": pa.array([bloom_bits(keys.column("hash").to_numpy())], pa.binary())})

        written.groupBy("bucket").applyInArrow(bloom, BLOOM).write.mode("overwrite").parquet(f"{self.path}/bloom/version={number}")
        counts = [(r["bucket"], number, r["count"], commit) for r in written.groupBy("bucket").count().collect()]
        kept = [p for p in old if p[0] not in gone]
        self.spark.createDataFrame([*kept, *counts], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={number}")

    def upsert(self, delivery: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], commit: int | None = None) -> None:
        """``merge(stored, delivery)`` becomes the content of the buckets that the delivery's keys fall into."""
        delivery = materialise(delivery, "delivery")
        touched = self._touched(delivery)
        if touched:
            self._write(merge(self.read(touched), delivery), touched, commit)

    def remove(self, keys: DataFrame, commit: int | None = None) -> None:
        """The rows with these keys go."""
        keys = materialise(keys.select(self.key).distinct(), "gone")
        touched = self._touched(keys)
        if touched:
            self._write(self.read(touched).join(keys, self.key, "left_anti"), touched, commit)

    def may_know(self, keys: DataFrame) -> DataFrame:
        """``key`` and ``bucket`` of the distinct keys that a stored part may hold, by the Bloom filters alone."""
        asked = self._in_bucket(keys.select(self.key).distinct()).select(F.col(f"`{self.key}`").alias("key"), "bucket", self._hash().alias("hash"))
        kind = dict(asked.dtypes)["key"]
        live = [(b, part) for b, part, rows, _ in self.parts() if rows]
        if not live:
            return asked.select("key", "bucket").where("false")
        filters = self.spark.read.schema(BLOOM).parquet(*sorted({f"{self.path}/bloom/version={part}" for _, part in live}))
        filters = filters.join(F.broadcast(self.spark.createDataFrame(live, "bucket int, part long")), ["bucket", "part"], "left_semi")

        def probe(key, some, blooms):
            hashes, found = some.column("hash").to_numpy(), np.zeros(some.num_rows, bool)
            for bits in blooms.column("bits").to_pylist():
                found |= may_hold(bits, hashes)
            return some.filter(pa.array(found)).select(["key", "bucket"])

        return asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(probe, f"key {kind}, bucket int")

    def missing(self, rows: DataFrame) -> DataFrame:
        """The rows whose key isn't stored; a null key never is. Only buckets for which a filter answers yes are read, and of them only the key."""
        maybe = materialise(self.may_know(rows), "maybe")
        buckets = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
        if not buckets:
            return rows
        known = self.read(buckets).select(self.key).join(maybe.select(F.col("key").alias(self.key)), self.key, "left_semi")
        return rows.join(known, self.key, "left_anti")

    def add(self, rows: DataFrame, commit: int | None = None) -> None:
        """Rows whose key isn't stored yet become parts of their own; the caller gives one row for each key.

        ``commit`` numbers the writes of a stream: a number that was written already is left out, so a batch that is
        run again adds nothing.
        """
        last = self.last_commit()
        if commit is not None and last is not None and commit <= last:
            return
        fresh = materialise(self.missing(rows), "fresh")
        touched, count = self._touched(fresh), {}
        for bucket, _, n, _ in self.parts():
            count[bucket] = count.get(bucket, 0) + bool(n)
        full = [b for b in touched if count.get(b, 0) >= self.most_parts - 1]
        if touched:
            self._write(fresh.unionByName(self.read(full)) if full else fresh, full, commit)
