"""Keyed state over request and fetch streams."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow import rules
from corpusflow.operators.ordered import count_hits, retry_seconds

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: Shares that the keys of an ordered stream are dealt over; a checkpoint belongs to one number of them.
SHARES = 64
#: Slots of time that the waiting rows of a share lie in, over the lateness, and the least length of one.
SLOTS, LEAST_SLOT_MICROS = 4, 60_000_000


def prepare_state_store(spark) -> None:
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


def _pack(frame: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(packed: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(packed)).read_pandas()


class _InOrder(StatefulProcessor):
    """Rows of each key in event-time order, whatever order they arrive in.

    The keys are dealt over shares, and the state is that of a share, so the calls to the state store are few however
    many keys there are. A row waits in its slot of time until the watermark has passed it, so none can come before it any
    more; then the ready rows are walked by key, time and tie, slot by slot. What the walks carry on is one row a
    key, dropped when it says nothing any more. A timer stands at the share's earliest waiting row, or, when none waits,
    where a carried state ends first. What waits is what was sent within the lateness; a task holds one slot of a share.
    """

    #: Columns of the carried state, and what the walk adds to a row.
    carried: str
    added: tuple[str, ...]

    def __init__(self, names: list[str], slot: int):
        self.names, self.slot = names, slot

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # waiting rows in parts, numbered as they came in; ``first`` is the time of a part's earliest row
        self.held = handle.getMapState("held", "slot long, part long, first long", "rows binary")
        self.parts = handle.getValueState("parts", "n long")
        self.state = handle.getValueState("state", "carried binary")

    def walk(self, state: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[list]]:
        """The state of a key after its rows (none: nothing to keep), and the added columns."""
        raise NotImplementedError

    def ends(self, state: tuple) -> int | None:
        """When the state says nothing any more, in microseconds."""
        raise NotImplementedError

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def _hold(self, part: int, slot: int, rows: pd.DataFrame) -> None:
        self.held.updateValue((int(slot), int(part), int(rows["us_"].min())), (_pack(rows),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        part, first = int(self.parts.get()[0]) if self.parts.exists() else 0, None
        for frame in rows:
            frame = frame.loc[frame["real_"], self.names]
            if frame.empty:
                continue
            for slot, of_slot in frame.groupby(frame["us_"] // self.slot, sort=False):
                self._hold(part, slot, of_slot)
            part += 1
            least = int(frame["us_"].min())
            first = least if first is None else min(first, least)
        if first is not None:
            self.parts.update((part,))
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        carried, changed, first, slots = self._carried(), False, None, {}
        for slot, part, earliest in sorted(tuple(map(int, k)) for k in self.held.keys()):
            slots.setdefault(slot, []).append((slot, part, earliest))
        for slot, parts in slots.items():
            earliest = min(p[2] for p in parts)
            if earliest > passed:
                first = earliest  # slots are in order
                break
            waiting = pd.concat([_unpack(self.held.getValue(p)[0]) for p in parts], ignore_index=True)
            ready = waiting["us_"] <= passed
            for p in parts:
                self.held.removeKey(p)
            changed = True
            yield self._walked(carried, waiting[ready])
            if not ready.all():
                first = int(waiting.loc[~ready, "us_"].min())
                self._hold(parts[0][1], slot, waiting[~ready])
                break
        over = [k for k, state in carried.items() if (end := self.ends(state)) is not None and end <= passed]
        for k in over:
            del carried[k]
        if first is None and self.parts.exists():
            self.parts.clear()
        if first is not None:
            self._wake(first)
        elif (end := min((e for e in map(self.ends, carried.values()) if e is not None), default=None)) is not None:
            self._wake(end)
        if changed or over:
            self._carry(carried)

    def _walked(self, carried: dict[str, tuple], rows: pd.DataFrame) -> pd.DataFrame:
        """The rows, sorted, with the added columns; ``carried`` is brought up to date."""
        rows = rows.sort_values(["key_", "us_", "tie_"], kind="stable", ignore_index=True)
        keys = rows["key_"].to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        tuples = list(rows.drop(columns=["key_", "row_", "tie_"]).itertuples(index=False, name=None))
        columns = [[] for _ in self.added]
        for lo, hi in zip(cuts, cuts[1:]):
            state, more = self.walk(carried.pop(keys[lo], None), tuples[lo:hi])
            if state:
                carried[keys[lo]] = state
            for column, values in zip(columns, more, strict=True):
                column.extend(values)
        return pd.DataFrame({"row_": rows["row_"], **dict(zip(self.added, columns, strict=True))})

    def _carried(self) -> dict[str, tuple]:
        if not self.state.exists():
            return {}
        keys, *values = (c.tolist() for _, c in _unpack(self.state.get()[0]).items())
        return dict(zip(keys, zip(*values)))

    def _carry(self, carried: dict[str, tuple]) -> None:
        if carried:
            names = [part.split()[0] for part in self.carried.split(", ")]
            columns = dict(zip(names, map(list, zip(*carried.values()))))
            self.state.update((_pack(pd.DataFrame({"key_": list(carried), **columns})),))
        elif self.state.exists():
            self.state.clear()

    def close(self) -> None:
        pass


def _key_text(rows: DataFrame, keys: Sequence[str], exact: dict[str, str]) -> Column:
    """One text for equal keys, nulls and both zeros included."""
    plain = lambda k: F.col(k) + F.lit(0.0).cast(rows.schema[k].dataType) if isinstance(rows.schema[k].dataType, (T.FloatType, T.DoubleType)) else F.col(k)
    return F.to_json(F.struct(*[plain(k).alias(f"k{i}") for i, k in enumerate(keys)]), exact)


def _in_order(rows: DataFrame, keys: Sequence[str], ts: str, tie: str, late: str, processor: type[_InOrder], columns: str, *settings, shares: int = SHARES, **extra) -> DataFrame:
    """Rows with what ``processor`` adds (``columns``). They travel as text, so no type of theirs changes on the way."""
    exact = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    timed = rows.withColumn("ts_", F.col(ts).cast("timestamp")).withWatermark("ts_", late)
    # the end marker moves the watermark and is left out behind it (a condition would be moved before it)
    real = F.col(tie).isNotNull() & F.col("ts_").isNotNull()
    keyed = timed.withColumns({
        "us_": F.coalesce(F.unix_micros("ts_"), F.lit(0)), "tie_": F.coalesce(F.col(tie), F.lit(0).cast(rows.schema[tie].dataType)), "real_": real,
        "row_": F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), exact), "key_": _key_text(rows, keys, exact), **extra,
    })
    names = ["us_", "tie_", "row_", "key_", *extra]
    sent = keyed.select("ts_", "real_", *names, F.pmod(F.xxhash64("key_"), F.lit(shares)).alias("share_"))
    lateness = rows.sparkSession.sql("SELECT unix_micros(timestamp_seconds(0) + CAST(:late AS INTERVAL)) AS us", {"late": late}).first()["us"]
    slot = max(LEAST_SLOT_MICROS, lateness // SLOTS)
    out = sent.groupBy("share_").transformWithStateInPandas(
        statefulProcessor=processor(names, slot, *settings), outputStructType=f"row_ string, {columns}", outputMode="Append", timeMode="EventTime"
    )
    return out.withColumn("row_", F.from_json("row_", rows.schema, exact)).select("row_.*", *[c.split()[0] for c in columns.split(", ")])


def end_marker(spark, schema, ts: str, last: Column) -> DataFrame:
    """A row with nothing but a time. Landed after the last file of a finite stream, with a time beyond lateness and windows, it
    lets everything come out that still waits."""
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != ts]
    return spark.range(1).select(last.cast(schema[ts].dataType).alias(ts), *empty).select([f.name for f in schema.fields])


class _OpenWindow(_InOrder):
    """When the open window ends and how many hits it has."""

    carried, added = "end long, count long", ("hit_no", "left_")

    def __init__(self, names: list[str], slot: int, span: int):
        super().__init__(names, slot)
        self.span = span

    def walk(self, state, rows):
        end, count = state or (int(np.iinfo(np.int64).min), 0)
        us = np.array([r[0] for r in rows], dtype=np.int64)
        none = np.zeros(len(us), dtype=np.int64)
        numbers, until, end, count = count_hits(us, none.astype(bool), none, none, self.span, int(end), int(count))
        return (end, count), [numbers, (np.array(until) - us).tolist()]

    def ends(self, state):
        return int(state[0])


def rate_limit_stream(
    hits: DataFrame, keys: Sequence[str], ts: str, tie: str, limit: int = rules.RATE_LIMIT_PER_WINDOW,
    window_seconds: int = rules.RATE_WINDOW_SECONDS, late: str = "10 seconds",
) -> DataFrame:
    """Streaming form of ``first_hit_windows``, in the order of ``ts`` and ``tie`` however the hits arrive.

    A hit is judged when the watermark has passed it; hits more than ``late`` behind the newest are dropped, as are
    hits without time or tie. A key's state goes when its window has ended.
    """
    decided = _in_order(hits, keys, ts, tie, late, _OpenWindow, "hit_no long, left_ long", window_seconds * 1_000_000)
    refused = F.col("hit_no") > limit
    return decided.withColumns(
        {"allowed": ~refused, "retry_after": F.when(refused, retry_seconds(F.col("left_")))}
    ).drop("left_")


def clock_windows(hits: DataFrame, keys: Sequence[str], ts: str, window_seconds: int = rules.RATE_WINDOW_SECONDS,
                  late: str = "10 minutes") -> DataFrame:
    """Hits per key in clock-aligned windows, each out when the watermark has passed it; later rows than ``late`` are dropped."""
    timed = hits.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.window("_ts", f"{window_seconds} seconds"), *keys).agg(F.count("*").alias("hits"))


class _Streak(_InOrder):
    """The current number of consecutive failures, and the time of the last."""

    carried, added = "n long, last long", ("streak",)

    def __init__(self, names: list[str], slot: int, idle: int | None):
        super().__init__(names, slot)
        self.idle = idle

    def walk(self, state, rows):
        streak, last = (int(x) for x in state or (0, 0))
        out = []
        for us, failed in rows:
            over = self.idle is not None and streak and us >= last + self.idle
            streak, last = ((0 if over else streak) + 1 if failed else 0), us
            out.append(streak)
        return ((streak, last) if streak else None), [out]

    def ends(self, state):
        return None if self.idle is None else int(state[1]) + self.idle


def streak_stream(calls: DataFrame, keys: Sequence[str], ts: str, tie: str, failed, late: str = "10 seconds", idle_seconds: int | None = None) -> DataFrame:
    """Streaming form of ``failure_streak``, in the order of ``ts`` and ``tie`` however the calls arrive.

    Only keys that are failing have state. With ``idle_seconds`` a streak without a call for so long is forgotten.
    """
    bad = F.coalesce(failed, F.lit(False))
    return _in_order(calls, keys, ts, tie, late, _Streak, "streak int", idle_seconds and idle_seconds * 1_000_000, failed_=bad)


def single_use_stream(claims: DataFrame, token: str, ts: str, ttl: str) -> DataFrame:
    """First claim of every token; later ones within its time to live are dropped."""
    return claims.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([token])


def revocation_stream(uses: DataFrame, epochs: DataFrame, user: str, issued_at: str, epoch: str = "epoch") -> DataFrame:
    """Token uses against the table of session epochs, read anew every batch."""
    latest = epochs.groupBy(user).agg(F.max(epoch).alias("epoch"))
    revoked = F.coalesce(F.col(issued_at) < F.col("epoch"), F.lit(False))
    return uses.join(latest, user, "left").withColumn("revoked", revoked)
