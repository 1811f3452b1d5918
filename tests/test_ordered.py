"""Order-dependent operators against plain loops, with one key holding a third
of the rows and segments small enough to cut it many times."""

import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import ordered as O
from corpusflow.operators import windows as W

START = datetime(2024, 1, 1)


def make_log(n=1500, seed=5, span=20_000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        user = "hot" if rng.random() < 0.35 else f"u{rng.randrange(12)}"
        rows.append((i, user, START + timedelta(seconds=rng.randrange(span)), rng.random() < 0.6, rng.randrange(0, 60)))
    return rows


@pytest.fixture(scope="module")
def log(spark):
    rows = make_log()
    return rows, spark.createDataFrame(rows, "id long, user string, ts timestamp, failed boolean, size long")


def by_user(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


ORDER = lambda: [F.col("ts"), F.col("id")]


def cut(df, width=700):
    return O.with_segment(df, O.seconds(F.col("ts")), width)


@pytest.mark.parametrize("how, fn", [("sum", lambda acc, x: acc + x), ("max", max)])
def test_running(log, how, fn):
    rows, df = log
    got = {r["id"]: r["r"] for r in O.running(cut(df), ["user"], ORDER(), F.col("size"), "r", how).collect()}
    for items in by_user(rows).values():
        acc = 0
        for r in items:
            acc = fn(acc, r[4])
            assert got[r[0]] == acc


def test_following(log):
    rows, df = log
    got = {r["id"]: r["n"] for r in O.following(cut(df), ["user"], ORDER(), "id", "n").collect()}
    for items in by_user(rows).values():
        for r, nxt in zip(items, [*items[1:], None]):
            assert got[r[0]] == (nxt[0] if nxt else None)


def test_failure_streak(log):
    rows, df = log
    got = {r["id"]: r["streak"] for r in O.failure_streak(cut(df), ["user"], ORDER(), F.col("failed")).collect()}
    for items in by_user(rows).values():
        n = 0
        for r in items:
            n = n + 1 if r[3] else 0
            assert got[r[0]] == n


def test_streak_example(spark):
    rows = [(i, "s", START + timedelta(seconds=i), f == "F", 0) for i, f in enumerate("FFFFSF")]
    df = spark.createDataFrame(rows, "id long, user string, ts timestamp, failed boolean, size long")
    out = O.failure_streak(cut(df, 2), ["user"], ORDER(), F.col("failed")).orderBy("id")
    assert [r[0] for r in out.select(O.cool_down_seconds(F.col("streak"))).collect()] == [None, None, 900, 1200, None, None]
    rows = [(i, "s", START + timedelta(seconds=i), True, 0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, user string, ts timestamp, failed boolean, size long")
    out = O.failure_streak(cut(df, 2), ["user"], ORDER(), F.col("failed")).orderBy("id")
    rests = [r[0] for r in out.select(O.source_rest_until(F.col("ts"), F.col("streak"))).collect()]
    assert [r is not None for r in rests] == [False, False, True, False, False, True]
    assert rests[2] == START + timedelta(seconds=1802)


def windows_by_loop(items, span, limit):
    end, n, out = None, 0, {}
    for r in items:
        if end is None or r[2] >= end:
            end, n = r[2] + timedelta(seconds=span), 1
        else:
            n += 1
        wait = max(1, int((end - r[2]).total_seconds() + 0.5))
        out[r[0]] = (n, n <= limit, None if n <= limit else wait)
    return out


@pytest.mark.parametrize("span, segment, hot", [(60, 100, 50), (60, 30, 10), (300, 100, 0), (60, 100, 10**6), (1, 50, 20)])
def test_first_hit_windows(log, span, segment, hot):
    rows, df = log
    out = O.first_hit_windows(
        df.select("id", "user", "ts"), ["user"], "ts", "id", limit=3, window_seconds=span, segment_seconds=segment, hot_rows=hot
    )
    got = {r["id"]: (r["hit_no"], r["allowed"], r["retry_after"]) for r in out.collect()}
    want = {}
    for items in by_user(rows).values():
        want.update(windows_by_loop(items, span, 3))
    assert got == want


def test_rate_limit_example(spark):
    rows = [(i, "u", START + timedelta(seconds=s)) for i, s in enumerate([0, 10, 20, 59, 60, 61])]
    df = spark.createDataFrame(rows, "id long, user string, ts timestamp")
    out = O.first_hit_windows(df, ["user"], "ts", "id", limit=2).orderBy("id").collect()
    assert [r["allowed"] for r in out] == [True, True, False, False, True, True]
    assert [r["retry_after"] for r in out] == [None, None, 40, 1, None, None]


def test_null_keys_are_kept(spark):
    rows = [(i, None, START + timedelta(seconds=i)) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, user string, ts timestamp")
    out = O.first_hit_windows(df, ["user"], "ts", "id", limit=2, segment_seconds=2, hot_rows=1).orderBy("id").collect()
    assert [r["hit_no"] for r in out] == [1, 2, 3, 4, 5]
    assert O.running(cut(df, 2), ["user"], ORDER(), F.lit(1), "n").count() == 5


def quota_by_loop(items, quota, most):
    used, out = 0, {}
    for r in items:
        if r[4] <= 0:
            out[r[0]] = "empty"
        elif r[4] > most:
            out[r[0]] = "too_large"
        elif used + r[4] > quota:
            out[r[0]] = "over_quota"
        else:
            used += r[4]
            out[r[0]] = "accepted"
    return out


@pytest.mark.parametrize("width", [100, 700, 10**6])
def test_quota(log, width):
    rows, df = log
    out = O.quota_admission(cut(df, width), "user", ORDER(), "size", quota=1000, max_item=55)
    got = {r["id"]: r["outcome"] for r in out.collect()}
    want = {}
    for items in by_user(rows).values():
        want.update(quota_by_loop(items, 1000, 55))
    assert got == want


def test_quota_in_rounds_walks_no_key_whole(spark, monkeypatch):
    rng = random.Random(5)
    items = [("hot" if rng.random() < 0.4 else f"u{rng.randrange(12)}", i, rng.choice([1, 2, 3, 30, 31, 50])) for i in range(900)]
    df = spark.createDataFrame(items, "who string, n long, size long")
    walks, write = [], O.materialise

    def written(frame, purpose):
        out = write(frame, purpose)
        rest = out.where("outcome is not null")  # what a round has walked
        walks.append(max((r["count"] for r in rest.groupBy("_who").count().collect()), default=0))
        return out

    monkeypatch.setattr(O, "materialise", written)
    got = {r["n"]: r["outcome"] for r in O.quota_admission(O.with_segment(df, F.col("n"), 20), "who", [F.col("n")], "size", quota=400, max_item=60, walk_rows=5).collect()}
    want = {}
    for who in {w for w, _, _ in items}:
        want.update(quota_by_loop([(n, w, None, None, s) for w, n, s in items if w == who], 400, 60))
    assert got == want and len([w for w in walks if w]) >= 2 and max(walks) < 5 + 20


def test_quota_examples(spark):
    for sizes, want in (([60, 60], ["accepted", "over_quota"]), ([60, 60, 30], ["accepted", "over_quota", "accepted"])):
        rows = [(i, "u", START, False, s) for i, s in enumerate(sizes)]
        df = spark.createDataFrame(rows, "id long, user string, ts timestamp, failed boolean, size long")
        out = O.quota_admission(cut(df), "user", ORDER(), "size", quota=100).orderBy("id").collect()
        assert [r["outcome"] for r in out] == want


def test_segment_width(log):
    _, df = log
    width = O.segment_width(df, O.seconds(F.col("ts")), rows_per_segment=100)
    assert 20_000 / 20 < width < 20_000 / 10


def test_rolling_context_blocks(spark):
    rows = [("hot", i * 2, f"t{i}") for i in range(40)] + [("b", 0, "x")]
    df = spark.createDataFrame(rows, "s string, turn long, text string")
    got = {(r["s"], r["turn"]): r["context"] for r in W.rolling_context(df, "s", "turn", "text", previous=6, width=8).collect()}
    assert len(got) == 41
    for i in range(40):
        assert got["hot", i * 2] == "\n".join(f"t{j}" for j in range(max(0, i - 6), i))
    assert got["b", 0] == ""


def test_positions(log):
    rows, df = log
    out = W.positions(df, ["user"], ORDER(), O.seconds(F.col("ts")), 500).collect()
    got = {r["id"]: r["position"] for r in out}
    for items in by_user(rows).values():
        assert [got[r[0]] for r in items] == list(range(len(items)))


def test_tokens_and_epochs(spark):
    at = lambda s: START + timedelta(seconds=s)
    df = spark.createDataFrame(
        [(1, "v", "u", at(0), None), (2, "v", "u", at(5), at(8)), (3, "v", "u", at(50), None), (4, "p", "u", at(1), None)],
        "id long, purpose string, user string, issued timestamp, used timestamp",
    )
    out = W.token_validity(df, ["purpose", "user"], "issued", "used", 100, "id", segment_seconds=4).orderBy("id").collect()
    assert [(r["valid_until"], r["ended_by"]) for r in out] == [
        (at(5), "superseded"), (at(8), "consumed"), (at(150), "expired"), (at(101), "expired")
    ]
    ev = spark.createDataFrame(
        [(1, "u", at(0), False, at(0)), (2, "u", at(10), True, None), (3, "u", at(11), False, at(9)), (4, "u", at(12), False, at(10)),
         (5, "w", at(12), False, at(0))],
        "id long, user string, ts timestamp, epoch_event boolean, iat timestamp",
    )
    got = W.session_epochs(ev, "user", "ts", "id", F.col("epoch_event"), F.col("iat"), segment_seconds=5).orderBy("id").collect()
    assert [(r["id"], r["revoked"]) for r in got] == [(1, False), (3, True), (4, False), (5, False)]


def test_quota_of_a_null_key(spark):
    rows = [(None, i, 60) for i in range(4)] + [(2**60 + 1, i, 60) for i in range(2)]
    df = spark.createDataFrame(rows, "who long, n long, size long")
    cut = O.with_segment(df, F.col("n"), 2)
    got = O.quota_admission(cut, "who", [F.col("n")], "size", quota=100, max_item=80).collect()
    assert sorted((str(r["who"]), r["n"]) for r in got if r["outcome"] == "accepted") == [(str(2**60 + 1), 0), ("None", 0)] and len(got) == 6


def test_segments_are_summarised_many_at_a_time():
    """Small groups come in as many frames as they were sent in, and hits of all groups are chained at once."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"user": rng.integers(0, 900, 4_000), "us": rng.integers(0, 400, 4_000)}).sort_values(["user", "us"], ignore_index=True)
    frame["user"] = frame["user"].where(frame["user"] != 899)
    batches = [frame.iloc[i : i + 1_000] for i in range(0, 4_000, 1_000)]
    out = list(O._whole_groups(iter(batches), ["user"]))
    assert len(out) <= len(batches) + 1 and pd.concat(out, ignore_index=True).equals(frame)
    assert sum(part["user"].nunique(dropna=False) for part in out) == frame["user"].nunique(dropna=False)
    one = pd.DataFrame({"user": [1] * 5, "us": range(5)})
    assert [len(part) for part in O._whole_groups(iter([one[:2], one[2:4], one[4:]]), ["user"])] == [5]

    codes, us = O._codes(frame, ["user"]), frame["us"].to_numpy()
    ends, counts = O._window_exits(codes, us, 30)
    for i in range(0, 4_000, 7):
        rest = us[i:][codes[i:] == codes[i]]
        opened = rest[0]
        while (later := rest[rest >= opened + 30]).size:
            opened = later[0]
        held = us[codes == codes[i]]
        assert (ends[i], counts[i]) == (opened + 30, (held >= opened).sum())


def test_hits_without_a_time_are_decided_in_segments_too(spark):
    rows = [(i, "u", None if i % 4 == 0 else START + timedelta(seconds=i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, user string, ts timestamp")
    cut, whole = (O.first_hit_windows(df, ["user"], "ts", "id", limit=2, window_seconds=5, segment_seconds=2, hot_rows=hot).select("id", "hit_no", "allowed") for hot in (1, 100))
    assert sorted(cut.collect()) == sorted(whole.collect()) and cut.count() == 20
