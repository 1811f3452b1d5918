"""Corpus files: scan, front matter, upsert, change detection, deletion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions.basic import col, strip


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """All ``*.md`` and ``*.txt`` files below a folder as (source_path, raw)."""
    return (
        spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,txt}", recursiveFileLookup=True)
        .select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("raw"))
    )


def front_matter(raw: Column | str) -> Column:
    """``struct<meta, body>`` of a file that may start with a ``---`` block.

    A block that is never closed counts as no metadata. Needs
    ``spark.sql.mapKeyDedupPolicy=LAST_WIN``: the last of a repeated key wins.
    """
    raw = col(raw)
    parts = F.split(raw, "---", 3)
    fenced = raw.startswith("---") & (F.size(parts) == 3)
    lines = F.filter(F.split(strip(F.try_element_at(parts, F.lit(2))), r"\r\n|\n|\r"), lambda x: x.contains(":"))
    entries = F.transform(
        lines,
        lambda x: F.struct(
            strip(F.substring_index(x, ":", 1)).alias("key"),
            strip(F.substring(x, F.locate(":", x) + 1, F.length(x))).alias("value"),
        ),
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.struct(
        F.when(fenced, F.map_from_entries(entries)).otherwise(empty).alias("meta"),
        F.when(fenced, strip(F.try_element_at(parts, F.lit(3)))).otherwise(raw).alias("body"),
    )


def parse_corpus(files: DataFrame) -> DataFrame:
    """(source_path, raw) -> (source_path, title, era, region, meta, body)."""
    stem = F.regexp_extract(F.col("source_path"), r"([^/]+?)(?:\.[^./]+)?$", 1)
    parsed = files.select("source_path", front_matter("raw").alias("fm"))
    meta = F.col("fm.meta")
    return parsed.select(
        "source_path",
        F.coalesce(meta["title"], stem).alias("title"),
        meta["era"].alias("era"),
        meta["region"].alias("region"),
        meta.alias("meta"),
        F.col("fm.body").alias("body"),
    )


def upsert_documents(current: DataFrame, incoming: DataFrame, key: str = "source_path", id_col: str = "id") -> DataFrame:
    """New content replaces old under the same key; ids and untouched rows stay.

    New keys get an id derived from the key, so a retried write is the same
    write.
    """
    fields = [c for c in current.columns if c not in (key, id_col)]
    c, n = current.alias("c"), incoming.alias("n")
    joined = c.join(n, F.col(f"c.{key}") == F.col(f"n.{key}"), "full_outer")
    arrived = F.col(f"n.{key}").isNotNull()
    the_key = F.coalesce(F.col(f"n.{key}"), F.col(f"c.{key}"))
    return joined.select(
        F.coalesce(F.col(f"c.{id_col}"), F.sha2(the_key.cast("string").cast("binary"), 256)).alias(id_col),
        the_key.alias(key),
        *[F.when(arrived, F.col(f"n.{f}")).otherwise(F.col(f"c.{f}")).alias(f) for f in fields],
    )


def replace_chunks(current: DataFrame, incoming: DataFrame, touched: DataFrame, key: str = "source_path") -> DataFrame:
    """All chunks of touched documents go, the new ones come."""
    kept = current.join(touched.select(key).distinct(), key, "left_anti")
    return kept.unionByName(incoming)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Classify every key as new, changed, deleted or same by content digest;
    NULL content is a content of its own.

    Only digests are shuffled, never the content.
    """
    digest = lambda df, name: df.select(
        key, F.struct(F.sha2(F.col(content).cast("binary"), 256).alias("digest")).alias(name)
    )
    joined = digest(old, "was").join(digest(new, "is"), key, "full_outer")
    status = (
        F.when(F.col("was").isNull(), "new")
        .when(F.col("is").isNull(), "deleted")
        .when(F.col("was.digest").eqNullSafe(F.col("is.digest")), "same")
        .otherwise("changed")
    )
    return joined.select(key, status.alias("status"))


def cascade_delete(children: DataFrame, deleted_parents: DataFrame, on: str) -> DataFrame:
    """Children whose parent survives."""
    return children.join(deleted_parents.select(on), on, "left_anti")


def insert_absent(current: DataFrame, seed: DataFrame, key: Sequence[str]) -> DataFrame:
    """Add seed rows whose natural key is not there yet; safe to repeat."""
    fresh = seed.dropDuplicates(list(key)).join(current.select(*key), list(key), "left_anti")
    return current.unionByName(fresh.select(*current.columns))
