"""Allow and block rules for URLs by a sort-merge range join.

A host's labels in reverse order, each followed by ``#``, are its key. A rule's host covers exactly the
keys that begin with its own key, which is an interval of sorted keys; intervals of rules nest or are
disjoint. Addresses are dealt to ranges of their keys, each rule goes to the ranges its interval meets, and
in a range one sweep over addresses and rules in order keeps the rules that are open as a stack. Of the
open rules whose path begins the address's path, the longest decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.org`` becomes ``org#example#www#``; ``#`` is in no host."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "#"), F.lit("#"))


class _Open:
    """The rules of one host while the sweep is inside its interval."""

    def __init__(self, key: str):
        self.key, self.by_path, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        # the same rule twice with different verdicts: block wins
        if path not in self.by_path or verdict == "block":
            self.by_path[path] = (rule, verdict)
        self.lengths = sorted({len(p) for p in self.by_path}, reverse=True)

    def fits(self, path: str) -> tuple[str, str] | None:
        return next((hit for n in self.lengths if n <= len(path) and (hit := self.by_path.get(path[:n]))), None)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block); a rule is written host then path. Of
    rules that fit, the longest text wins. Without one the rule is null and the verdict
    ``default``; so it is for a null address, or one without ``://``. Repeated rows give repeated rows,
    a null id stays null, rules with a null are left out. Equal keys are dealt to ranges by id and digest
    as well, so a host with a third of all rows is many ranges.
    """
    ranges = ranges or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", host_key(F.col("host")))
    salt = F.xxhash64("page_id", "host", "path")
    dealt = materialise(rows.repartitionByRange(ranges, "key", salt).withColumn("range", F.spark_partition_id()), "urls")
    bounds = sorted(tuple(r) for r in dealt.groupBy("range").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect())  # a row for each range
    numbers, lows, highs = ([b[i] for b in bounds] for i in range(3))

    def to_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                key = row["key"]
                after = key[:-1] + chr(ord("#") + 1)  # the end of the interval
                out += [{"range": numbers[i], **row} for i in range(bisect_left(highs, key), bisect_left(lows, after))]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("range", pa.int32()), *((c, pa.string()) for c in ("key", "path", "rule", "verdict"))]))

    usable = rules.dropna(subset=["host", "path", "verdict"])
    keyed = usable.select(host_key(F.translate("host", _UPPER, _LOWER)).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict")
    opened = keyed.mapInArrow(to_ranges, "range int, key string, path string, rule string, verdict string")
    events = opened.select("range", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit("").alias("host"), "path", "rule", "verdict").union(
        dealt.select("range", "key", F.lit(1), "page_id", "host", "path", F.lit(None).cast("string"), F.lit(None).cast("string"))
    )
    events = events.repartitionByRange(ranges, "range").sortWithinPartitions("range", "key", "kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack = None, []
        for batch in batches:
            kept, found = [], []
            for i, (number, key, kind, path, rule, verdict) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("range", "key", "kind", "path", "rule", "verdict")), strict=True)):
                if number != current:
                    current, stack = number, []
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(_Open(key))
                    stack[-1].add(path, rule, verdict)
                    continue
                hits = [hit for entry in stack if (hit := entry.fits(path))]
                kept.append(i)
                found.append(max(hits, key=lambda hit: len(hit[0])) if hits else (None, default))
            out = batch.select(["page_id", "host", "path"]).take(pa.array(kept, pa.int64()))
            columns = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*out.columns, *columns], names=["page_id", "host", "path", "rule", "verdict"])

    return events.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
