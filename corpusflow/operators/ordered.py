"""Order-dependent results per key, without putting a whole key in one task.

A key is cut into segments of its order column. Each ``(key, segment)`` is
worked on alone, a small summary per segment carries the state from one segment
to the next, and the carried state is joined back on ``(key, segment)``. A key
that holds a third of all rows is then many segments like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.session import materialise

SEGMENT = "_segment"
KEY = "_key"
_NO_WINDOW = int(np.iinfo(np.int64).min)


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000


def with_segment(df: DataFrame, order: Column, width: float) -> DataFrame:
    """``width`` is in units of the order column (seconds for times). Pick it so
    that one segment of the busiest key still fits a task."""
    return df.withColumn(SEGMENT, F.floor(order / F.lit(width)).cast("long"))


def segment_width(df: DataFrame, order: Column, rows_per_segment: int = 1_000_000) -> float:
    """A width that gives about ``rows_per_segment`` rows of the whole table per
    segment. One aggregate over a single column; three numbers come back."""
    row = df.agg(F.count("*").alias("n"), F.min(order).alias("lo"), F.max(order).alias("hi")).first()
    if not row["n"] or row["hi"] == row["lo"]:
        return 1.0
    return float(row["hi"] - row["lo"]) / max(1, row["n"] // rows_per_segment)


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the keys as one struct. It is never NULL and equal for NULL keys, so
    windows, aggregates and joins on it and the segment share one distribution."""
    return df.withColumn(KEY, F.struct(*[F.col(k) for k in keys] or [F.lit(0).alias("all")]))


def running_all(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: dict[str, Column], how: str = "sum"
) -> DataFrame:
    """Inclusive running ``sum`` or ``max`` of several values per key, in one
    pass; needs :func:`with_segment`."""
    fn = {"sum": F.sum, "max": F.max}[how]
    part = [KEY, SEGMENT]
    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(KEY).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    df = _keyed(df, keys).withColumns({f"_v_{out}": value for out, value in values.items()})
    totals = df.groupBy(*part).agg(*[fn(f"_v_{out}").alias(f"_t_{out}") for out in values])
    carry = totals.select(*part, *[fn(f"_t_{out}").over(before).alias(f"_c_{out}") for out in values])
    joined = df.withColumns({f"_l_{out}": fn(f"_v_{out}").over(local) for out in values}).join(carry, part)
    zero = F.lit(0)
    results = {
        out: F.coalesce(F.col(f"_l_{out}"), zero) + F.coalesce(F.col(f"_c_{out}"), zero)
        if how == "sum" else F.greatest(f"_l_{out}", f"_c_{out}")
        for out in values
    }
    helpers = [f"_{kind}_{out}" for kind in "vlc" for out in values]
    return joined.withColumns(results).drop(KEY, *helpers)


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str, how: str = "sum"
) -> DataFrame:
    return running_all(df, keys, order, {out: value}, how)


def following(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """``value`` of the next row of the key (NULL on the last one)."""
    part, df = [KEY, SEGMENT], _keyed(df, keys)
    local = Window.partitionBy(*part).orderBy(*order)
    heads = df.groupBy(*part).agg(F.min_by(F.struct(value), F.struct(*order)).alias("_head"))
    later = Window.partitionBy(KEY).orderBy(SEGMENT)
    carry = heads.select(*part, F.lead("_head").over(later).alias("_next_head"))
    joined = df.withColumn("_next", F.lead(F.struct(value)).over(local)).join(carry, part)
    return joined.withColumn(out, F.coalesce("_next", "_next_head").getField(value)).drop(KEY, "_next", "_next_head")


# --- streaks -----------------------------------------------------------------

def failure_streak(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], failed: Column, out: str = "streak"
) -> DataFrame:
    """Consecutive failures up to and including each row; 0 on a success."""
    part = [KEY, SEGMENT]
    upto = lambda *cols: Window.partitionBy(*cols).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = (
        _keyed(df, keys).withColumn("_failed", F.coalesce(failed, F.lit(False)).cast("int"))
        .withColumn("_island", F.sum(1 - F.col("_failed")).over(upto(*part)))
        .withColumn("_run", F.sum("_failed").over(upto(*part, "_island")))
    )
    ends = local.groupBy(*part).agg(
        F.max(1 - F.col("_failed")).alias("_reset"),
        F.max_by("_run", F.struct(*order)).alias("_tail"),
    )
    by_key = Window.partitionBy(KEY).orderBy(SEGMENT)
    carry = (
        ends.withColumn("_grp", F.sum("_reset").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn(
            "_upto",
            F.sum("_tail").over(
                Window.partitionBy(KEY, "_grp").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .select(*part, F.coalesce(F.lag("_upto").over(by_key), F.lit(0)).alias("_carry"))
    )
    joined = local.join(carry, part)
    streak = F.col("_run") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)
    return joined.withColumn(
        out, F.when(F.col("_failed") == 1, streak).otherwise(0).cast("int")
    ).drop(KEY, "_failed", "_island", "_run", "_carry")


def cool_down_seconds(
    streak: Column, after: int = rules.COOL_DOWN_AFTER, step: int = rules.COOL_DOWN_STEP, most: int = rules.COOL_DOWN_MAX
) -> Column:
    """Pause after a failure streak; NULL when none is due."""
    return F.when(streak >= after, F.least(streak * step, F.lit(most))).cast("int")


def source_rest_until(
    ts: Column, streak: Column, after: int = rules.SOURCE_REST_AFTER, rest: int = rules.SOURCE_REST_SECONDS
) -> Column:
    """End of a source's rest; its failure counter starts anew after each rest."""
    due = (streak > 0) & (streak % after == 0)
    return F.when(due, ts + F.make_dt_interval(secs=F.lit(rest)))


# --- request windows ---------------------------------------------------------

def _codes(frame: pd.DataFrame, by: list[str]) -> np.ndarray:
    """Numbers of the groups of a sorted frame; nulls are equal."""
    return frame.groupby(by, sort=False, dropna=False).ngroup().to_numpy()


def _row_key(frame: pd.DataFrame, by: list[str], i: int) -> tuple:
    return tuple(None if pd.isna(v) else v for v in frame[by].iloc[i])


def _whole_groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of batches that are sorted by ``by`` in frames of whole groups, many to a frame."""
    held: list[pd.DataFrame] = []
    held_key = None
    for frame in frames:
        if frame.empty:
            continue
        codes = _codes(frame, by)
        # rows before the frame's last group; with none, the held group may go on
        cut = int(np.searchsorted(codes, codes[-1], side="left"))
        if held and (cut or _row_key(frame, by, 0) != held_key):
            yield pd.concat([*held, frame.iloc[:cut]], ignore_index=True)
            held = []
        elif cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held.append(frame.iloc[cut:])
        held_key = _row_key(frame, by, -1)
    if held:
        yield pd.concat(held, ignore_index=True)


def _window_exits(codes: np.ndarray, ts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For every hit taken as the first of a window: when the last window of
    the chain that follows in its group ends, and how many hits that window holds.

    Hits are sorted by ``codes`` (numbers of the groups) and time.
    """
    n = len(ts)
    rows = np.arange(n)
    group_end = np.searchsorted(codes, codes, side="right")
    # where each hit's window ends among the hits: hits and ends sorted together, an end before hits of its time
    order = np.lexsort((np.repeat([1, 0], n), np.append(ts, ts + span), np.append(codes, codes)))
    nxt = np.empty(n, dtype=np.int64)
    is_end = order >= n
    nxt[order[is_end] - n] = np.cumsum(~is_end)[is_end]
    last = rows
    jump = np.append(np.where(nxt < group_end, nxt, n), n)
    while True:
        alive = jump[:-1] < n
        if not alive.any():
            break
        # follow the chain in doubling steps; ``last`` is the deepest start seen
        last = np.where(alive, last[np.minimum(jump[:-1], n - 1)], last)
        jump = np.append(jump[jump[:-1]], n)
    # hits at the very moment a window opens are all in it
    new = np.append(True, (codes[1:] != codes[:-1]) | (ts[1:] != ts[:-1]))
    at_once = np.maximum.accumulate(np.where(new, rows, 0))
    return ts[last] + span, group_end - at_once[last]


def count_hits(
    us: np.ndarray, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, span: int, end: int = _NO_WINDOW, count: int = 0
) -> tuple[list[int], list[int], int, int]:
    """Walk hits in order: each one's number in its window and that window's end.

    Where ``starts`` is set a new key begins with the given open window.
    """
    numbers, until = [], []
    for t, fresh, open_end, open_count in zip(us.tolist(), starts.tolist(), ends.tolist(), counts.tolist()):
        if fresh:
            end, count = open_end, open_count
        if t >= end:
            end, count = t + span, 1
        else:
            count += 1
        numbers.append(count)
        until.append(end)
    return numbers, until, end, count


def retry_seconds(micros_left: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(micros_left / 1_000_000 + 0.5)).cast("int")


def first_hit_windows(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    tie: str,
    limit: int = rules.RATE_LIMIT_PER_WINDOW,
    window_seconds: int = rules.RATE_WINDOW_SECONDS,
    segment_seconds: int = 3_600,
    hot_rows: int = 1_000_000,
) -> DataFrame:
    """Fixed windows that open at a key's first hit, refused hits counting too.

    Adds ``hit_no`` (position in its window), ``allowed`` and ``retry_after``
    (seconds, NULL when allowed). Keys with more than ``hot_rows`` hits are cut
    into time segments. The state between segments is when the open window ends
    and how many hits it has; a segment's effect on it is a small step function
    of the incoming end time, so segments are summarised side by side and only
    the summaries are walked per key.
    """
    span, width = window_seconds * 1_000_000, segment_seconds * 1_000_000
    keys = list(keys)
    part = [*keys, SEGMENT]
    key_fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*keys, F.lit(True).alias("_hot"))
    renamed = hot.withColumnsRenamed({k: f"_h_{k}" for k in keys})
    same_key = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in keys]
    hits = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).join(renamed, same_key, "left")
    hits = hits.withColumn(
        SEGMENT, F.when(F.col("_hot"), F.floor(F.col("_us") / F.lit(width)).cast("long")).otherwise(F.lit(0).cast("long"))
    ).drop(*[f"_h_{k}" for k in keys])

    def step_functions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(frames, part):
            codes, us = _codes(frame, part), frame["_us"].to_numpy()
            ends, counts = _window_exits(codes, us, span)
            # an open window of earlier segments ends within ``span`` of this one's begin: up to the first hit after that
            limit = frame[SEGMENT].to_numpy() * width + span
            first = np.append(True, codes[1:] != codes[:-1])
            reached = first | np.append(True, us[:-1] < limit[1:])
            more = np.append(~first[1:] & reached[1:], False)
            keep = reached & ~(more & (np.append(ends[1:], 0) == ends))
            out = pd.DataFrame({"_upper": us, "_end": ends, "_count": counts})
            for k in part:
                out[k] = frame[k]
            out["_size"] = np.bincount(codes)[codes]
            yield out[keep]

    def carry_over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, end, count, segment, rest = None, _NO_WINDOW, 0, None, 0
        for frame in frames:
            if frame.empty:
                continue
            codes = _codes(frame, keys) if keys else np.zeros(len(frame), dtype=np.int64)
            fresh = np.append(_row_key(frame, keys, 0) != last, codes[1:] != codes[:-1])
            columns = [frame[c].tolist() for c in (SEGMENT, "_upper", "_end", "_count", "_size")]
            at, ends, counts = [], [], []
            for i, (new, seg, upper, then_end, then_count, size) in enumerate(zip(fresh.tolist(), *columns)):
                if new:
                    end, count, segment, rest = _NO_WINDOW, 0, None, 0
                if seg != segment:
                    # ``rest``: hits of a segment that are all in the window it was entered with
                    count += rest
                    at.append(i)
                    ends.append(end)
                    counts.append(count)
                    segment, rest = seg, size
                if rest and upper >= end:
                    end, count, rest = then_end, then_count, 0
            last = _row_key(frame, keys, -1)
            out = pd.DataFrame({SEGMENT: frame[SEGMENT].iloc[at].to_numpy(), "_open_end": ends, "_open_count": counts})
            for k in keys:
                out[k] = frame[k].iloc[at].to_numpy()
            yield out

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, end, count = None, _NO_WINDOW, 0
        for frame in frames:
            if frame.empty:
                continue
            codes = _codes(frame, part)
            starts = np.append(_row_key(frame, part, 0) != last, codes[1:] != codes[:-1])
            us = frame["_us"].to_numpy()
            numbers, until, end, count = count_hits(
                us, starts, frame["_open_end"].to_numpy(), frame["_open_count"].to_numpy(), span, end, count
            )
            last = _row_key(frame, part, -1)
            yield frame.drop(columns=["_us", SEGMENT, "_open_end", "_open_count"]).assign(
                hit_no=numbers, _left=np.array(until) - us
            )

    def sorted_by(frame: DataFrame, by: list[str], *order: str) -> DataFrame:
        return frame.repartition(*by).sortWithinPartitions(*by, *order)

    # hits without a time are in no window that goes on
    steps = sorted_by(hits.where("_hot AND _us IS NOT NULL").select(*part, "_us"), part, "_us").mapInPandas(
        step_functions, f"_upper long, _end long, _count long, {key_fields}, {SEGMENT} long, _size long"
    )
    entries = sorted_by(steps, keys, SEGMENT, "_upper").mapInPandas(
        carry_over, f"{SEGMENT} long, _open_end long, _open_count long, {key_fields}"
    )
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    entered = _keyed(hits.drop("_hot"), keys).join(_keyed(entries, keys).drop(*keys), [KEY, SEGMENT], "left").drop(KEY).withColumns(
        {
            "_open_end": F.coalesce("_open_end", F.lit(_NO_WINDOW).cast("long")),
            "_open_count": F.coalesce("_open_count", F.lit(0).cast("long")),
        }
    )
    decided = sorted_by(entered, part, "_us", tie).mapInPandas(decide, f"{fields}, hit_no long, _left long")
    refused = F.col("hit_no") > limit
    return decided.withColumns(
        {"allowed": ~refused, "retry_after": F.when(refused, retry_seconds(F.col("_left")))}
    ).drop("_left")


# --- quotas ------------------------------------------------------------------

def _settled_by_segments(rows: DataFrame, size: str) -> DataFrame:
    """Whole segments that fit into their key's room ``_left`` are admitted; of the others, what is larger than the
    room left before the first of them is refused. ``_left`` becomes that room."""
    part = ["_who", SEGMENT]
    counted = F.when(F.col("outcome").isNull(), F.col(size)).otherwise(0)
    upto = Window.partitionBy("_who").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.groupBy(*part).agg(F.sum(counted).alias("_size"), F.min("_left").alias("_room")).withColumn("_filled", F.sum("_size").over(upto))
    fits = F.col("_filled") <= F.col("_room")
    before = F.coalesce(F.max(F.when(fits, F.col("_filled"))).over(Window.partitionBy("_who")), F.lit(0))
    summary = filled.select(*part, fits.alias("_fits"), (F.col("_room") - before).cast("long").alias("_left"))
    return rows.drop("_left").join(summary, part).withColumn(
        "outcome",
        F.when(F.col("outcome").isNotNull(), F.col("outcome"))
        .when(F.col("_fits"), "accepted")
        .when(F.col(size) > F.col("_left"), "over_quota"),
    ).drop("_fits")


def _walk(size: str):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, left = None, 0
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            outcome, room = [], []
            for who, item, space in zip(*[columns[c].to_pylist() for c in ("_who", size, "_left")]):
                if who != current:
                    current, left = who, space
                fits = item is not None and item <= left
                left -= item if fits else 0
                outcome.append("accepted" if fits else "over_quota")
                room.append(left)
            columns["outcome"], columns["_left"] = pa.array(outcome, pa.string()), pa.array(room, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return walk


def quota_admission(
    df: DataFrame,
    key: str,
    order: Sequence[Column],
    size: str,
    quota: int = rules.UPLOAD_QUOTA_BYTES,
    max_item: int = rules.UPLOAD_MAX_BYTES,
    walk_rows: int = 100_000,
) -> DataFrame:
    """Admit items in order while they fit; a refused item uses no space.

    Not a running sum, since what is refused does not count. But as long as
    whole segments fit, everything in them is admitted; from the first segment
    that does not fit on, only items no larger than the space left before it can
    still be admitted. Segment totals therefore decide nearly every row. Of what
    is left of a key, its next segments of about ``walk_rows`` rows (one segment
    at least) are walked in order; their end leaves less space, with which the later
    segments are settled by totals again, and so on in rounds until nothing is left. No
    task walks more of a key than that, whatever the key holds.
    Needs :func:`with_segment`. Adds ``outcome``.
    """
    part, order_cols = ["_who", SEGMENT], [f"_o{i}" for i in range(len(order))]
    # text of the key: NULL is a key like any other
    who = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    rows = df.withColumns({**dict(zip(order_cols, order)), "_who": who, "_left": F.lit(quota).cast("long")}).withColumn(
        "outcome", F.when(F.col(size) <= 0, "empty").when(F.col(size) > max_item, "too_large")
    )
    earlier = Window.partitionBy("_who").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    columns = [*(c for c in df.columns if c != SEGMENT), "outcome"]
    done, judged = [], _settled_by_segments(rows, size)
    while True:
        done.append(judged.where(F.col("outcome").isNotNull()).select(columns))
        rest = materialise(judged.where(F.col("outcome").isNull()), "uploads")
        near = rest.groupBy(*part).count().select(*part, (F.coalesce(F.sum("count").over(earlier), F.lit(0)) < walk_rows).alias("_near"))
        dealt = rest.join(near, part)
        walked = (
            dealt.where("_near").select(rest.columns).repartition("_who").sortWithinPartitions("_who", *order_cols)
            .mapInArrow(_walk(size), rest.schema)
        )
        if near.where("NOT _near").isEmpty():
            return reduce(DataFrame.union, [*done, walked.select(columns)])
        walked = materialise(walked, "uploads")
        done.append(walked.select(columns))
        room = walked.groupBy("_who").agg(F.min("_left").alias("_left"))
        later = dealt.where("NOT _near").drop("_left", "_near").join(room, "_who")
        judged = _settled_by_segments(later.withColumn("outcome", F.when(F.col(size) > F.col("_left"), "over_quota")), size)
