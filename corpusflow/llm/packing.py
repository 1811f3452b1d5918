"""Best-fit packing of documents into sequences of bounded length.

Only the histogram of piece lengths, at most ``max_len`` numbers, reaches the driver. There
patterns of a few lengths that fill a sequence exactly are enumerated, their repeat counts
are fitted to the histogram by non-negative least squares and rounded, and what is left is
packed best-fit, longest first, into the gaps and into new sequences; all of it on counts,
so the plan is as large for a thousand documents as for a billion. The executors then give
each piece its place: its rank among the pieces of its length names its slot in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import gathered, id_and_text, materialise
from corpusflow.llm.tokens import encoder as shared_encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, max_len: int = 4096, keep_ids: bool = True) -> DataFrame:
    """Each document's ids and ``end_id``, cut every ``max_len`` ids where there are more.

    A null text is an empty one: its only piece holds the end id. Repeated rows give repeated
    pieces and a null doc_id stays null. ``ids`` are little-endian unsigned 32-bit integers,
    null without ``keep_ids``; ``ids_crc32`` is of those bytes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer)
        for batch in gathered(batches):
            rows: list[tuple] = []
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text")), strict=True):
                ids = np.append(np.frombuffer(found, dtype=f"<u{encoder.width}"), end_id).astype("<u4")
                for number, start in enumerate(range(0, len(ids), max_len)):
                    own = ids[start : start + max_len]
                    raw = own.tobytes()
                    rows.append((doc_id, number, start, len(own), raw if keep_ids else None, zlib.crc32(raw)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return id_and_text(docs).mapInArrow(cut, PIECES)


@dataclass
class Plan:
    """Runs of slots: ``count`` pieces of ``length`` that fill ``times`` slots of consecutive sequences.

    The arrays are sorted by length, then by the rank of a run's first piece among the pieces of
    its length; ``first[length]`` is where a length's runs begin.
    """

    first: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray
    sequences: int
    pattern_sequences: int


def patterns(histogram: np.ndarray, max_len: int, anchors: int = 48) -> list[tuple[int, ...]]:
    """Length patterns of one to four documents that fill a sequence exactly, of lengths that occur.

    All pairs; of triples and quadruples those whose lengths but the last are among the
    ``anchors`` (a third of them for quadruples), the commonest lengths of equal ranges.
    """
    have = histogram > 0
    common = []
    for part in np.array_split(np.arange(1, max_len), min(anchors, max_len - 1)) if max_len > 1 else []:
        if have[part].any():
            common.append(int(part[np.argmax(histogram[part])]))
    found = {(max_len,)} if have[max_len] else set()
    found |= {(max_len - a, a) for a in range(1, max_len // 2 + 1) if have[a] and have[max_len - a]}
    for size, lengths in ((2, common), (3, common[:: max(1, len(common) // 16)])):
        for some in combinations_with_replacement(lengths, size):
            last = max_len - sum(some)
            if last > 0 and have[last]:
                found.add(tuple(sorted((*some, last), reverse=True)))
    return sorted(found, reverse=True)


def fit(histogram: np.ndarray, found: list[tuple[int, ...]], sweeps: int = 60) -> np.ndarray:
    """Non-negative repeat counts whose lengths come as near as they can to the histogram, by least
    squares; solved by coordinate descent, since a pattern has a few non-zero entries."""
    columns = [tuple((length, pattern.count(length)) for length in sorted(set(pattern))) for pattern in found]
    norms = [sum(times * times for _, times in column) for column in columns]
    left, x = histogram.astype(float).tolist(), [0.0] * len(found)
    for _ in range(sweeps):
        moved = 0.0
        for j, column in enumerate(columns):
            step = max(-x[j], sum(times * left[length] for length, times in column) / norms[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for length, times in column:
                    left[length] -= times * step
        if moved < 0.05:
            break
    return np.array(x)


def plan_packing(histogram: np.ndarray, max_len: int = 4096) -> Plan:
    """Slots for ``histogram[length]`` pieces of each length from 1 to ``max_len``."""
    left = histogram.astype(np.int64).copy()
    groups: list[tuple[tuple[int, ...], int]] = []  # lengths of a sequence, number of such sequences
    found = patterns(left, max_len)
    wanted = fit(left, found)
    for j in np.argsort(-wanted, kind="stable"):
        pattern = found[j]
        times = min(int(np.rint(wanted[j])), *(int(left[v]) // pattern.count(v) for v in set(pattern)))
        if times > 0:
            groups.append((pattern, times))
            for v in pattern:
                left[v] -= times
    pattern_sequences = sum(times for _, times in groups)

    gaps: list[int] = []  # gaps with open sequences, ascending
    open_groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if gap not in open_groups:
            insort(gaps, gap)
            open_groups[gap] = []
        open_groups[gap].append((lengths, times))

    for length in range(max_len, 0, -1):
        n = int(left[length])
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):  # none has room: as many new sequences as it takes
                fill = max_len // length
                if n >= fill:
                    put(max_len - fill * length, (length,) * fill, n // fill)
                    n %= fill
                else:
                    put(max_len - n * length, (length,) * n, 1)
                    n = 0
                continue
            gap = gaps[at]
            lengths, times = open_groups[gap].pop()
            if not open_groups[gap]:
                del open_groups[gap]
                gaps.pop(at)
            fill = gap // length
            whole = min(times, n // fill)
            if whole:
                put(gap - fill * length, (*lengths, *(length,) * fill), whole)
                n, times = n - whole * fill, times - whole
            if times and n:
                put(gap - n * length, (*lengths, *(length,) * n), 1)
                times, n = times - 1, 0
            if times:
                put(gap, lengths, times)
    for gap in gaps:
        groups += open_groups[gap]

    runs: list[tuple[int, int, int, int, int]] = []
    ranks = np.zeros(max_len + 2, np.int64)
    sequence = 0
    for lengths, times in groups:
        offset = 0
        for v in sorted(set(lengths), reverse=True):
            n = lengths.count(v)
            runs.append((v, int(ranks[v]), sequence, n, offset))
            ranks[v] += n * times
            offset += n * v
        sequence += times
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    first = np.searchsorted(table[:, 0], np.arange(max_len + 2))
    return Plan(first, table[:, 1], table[:, 2], table[:, 3], table[:, 4], sequence, pattern_sequences)


def slots(plan: Plan, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces of given lengths and ranks among equal lengths."""
    # ranks of a length ascend from one run to the next: one search over (length, rank)
    top = int(plan.rank.max(initial=0)) + 1
    top = max(top, int(ranks.max(initial=0)) + 1)
    owner = np.repeat(np.arange(len(plan.first) - 1), np.diff(plan.first))
    at = np.searchsorted(owner * top + plan.rank, lengths * top + ranks, side="right") - 1
    inside = ranks - plan.rank[at]
    return plan.sequence[at] + inside // plan.times[at], plan.offset[at] + inside % plan.times[at] * lengths


def pack(found: DataFrame, max_len: int = 4096, rows_at_once: int = 100_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces (``doc_id``, ``piece``, ``length``; others stay).

    Pieces of one length are ranked in parts of about ``rows_at_once``, so a length that a third
    of all pieces have is many parts. An empty table stays empty.
    """
    spark = found.sparkSession
    counted = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most max_len rows
    histogram = np.zeros(max_len + 1, np.int64)
    for length, n in counted.items():
        histogram[length] = n
    plan = plan_packing(histogram, max_len)
    parts = spark.createDataFrame([(int(v), -(-int(n) // rows_at_once)) for v, n in counted.items()], "length long, __parts long")
    order = [F.col(c) for c in ("doc_id", "piece")] + [F.xxhash64(*[F.col(f"`{c}`") for c in found.columns])]
    salted = found.join(F.broadcast(parts), "length").withColumn("__part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(7)), F.col("__parts")))
    within = F.row_number().over(Window.partitionBy("length", "__part").orderBy(*order))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n")
    bases = salted.groupBy("length", "__part").agg(F.count("*").alias("__n")).select("length", "__part", before.alias("__base"))
    ranked = salted.withColumn("__within", within).join(bases, ["length", "__part"]).withColumn("__rank", F.col("__base") + F.col("__within") - 1)
    ranked = ranked.select(*found.columns, "__rank")
    schema = ", ".join(f"`{c}` {kind}" for c, kind in found.dtypes) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots(plan, batch.column("length").to_numpy(), batch.column("__rank").to_numpy())
            arrays = [batch.column(c) for c in batch.schema.names[:-1]] + [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` and the documents' ``spans``, from
    pieces that kept their ids. A group is one sequence, so never above the sequence length."""
    part = F.struct("offset", "length", "doc_id", "piece", "start", "ids")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"),
        F.transform("parts", lambda x: x.dropFields("ids")).alias("spans"),
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, max_len: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut, write and pack: one row per piece with its place."""
    return pack(materialise(pieces(docs, tokenizer, end_id, max_len, keep_ids), "pieces"), max_len)
