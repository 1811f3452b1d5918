from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.sources.corpus import upsert_documents
from corpusflow.sources.store import KeyedStore, bloom_bits, may_hold

SCHEMA = "id string, source_path string, text string"


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(f"id{i}", f"p{i}", f"text {i}") for i in range(200)]
    store = KeyedStore(spark, str(tmp_path / "store"), "source_path", SCHEMA, buckets=8, most_parts=3)
    store.add(spark.createDataFrame(rows, SCHEMA))
    return store, rows


def files(store):
    return {str(p.relative_to(store.path)): p.stat().st_mtime_ns for p in Path(store.path, "data").rglob("*.parquet")}


def live(store):
    return {f.rpartition("/store/")[2] for f in store.read().inputFiles()}


def test_an_upsert_of_one_key_leaves_the_other_buckets_files(spark, stored):
    store, rows = stored
    before, was = files(store), live(store)
    store.upsert(spark.createDataFrame([("p7", "new text")], "source_path string, text string"), upsert_documents)
    after = files(store)
    assert all(after[f] == t for f, t in before.items())  # nothing is written over
    changed = was - live(store)
    assert changed and len({f.split("/")[2] for f in changed}) == 1  # one bucket's
    assert sum("version=2" in f for f in live(store)) == len(live(store) - was) and len(was & live(store)) >= 7
    got = {r["source_path"]: (r["id"], r["text"]) for r in store.read().collect()}
    assert got == {p: (i, "new text" if p == "p7" else t) for i, p, t in rows}
    assert {r["text"] for r in store.read(version=1).where("source_path = 'p7'").collect()} == {"text 7"}  # the older version stays readable


def test_upsert_equals_the_whole_table_form(spark, stored):
    store, rows = stored
    delivery = spark.createDataFrame([(f"p{i}", f"later {i}") for i in range(150, 260, 3)], "source_path string, text string")
    want = upsert_documents(spark.createDataFrame(rows, SCHEMA), delivery).select("id", "source_path", "text")
    store.upsert(delivery, upsert_documents)
    assert sorted(map(tuple, store.read().collect())) == sorted(map(tuple, want.collect()))


def test_missing_reads_only_what_the_filters_say(spark, stored):
    store, rows = stored
    asked = spark.createDataFrame([(f"p{i}",) for i in range(100, 300)] + [("p150",), (None,)], "source_path string")
    got = sorted(str(r[0]) for r in store.missing(asked).collect())
    assert got == sorted([*(f"p{i}" for i in range(200, 300)), "None"])
    maybe = {r["key"] for r in store.may_know(asked).collect()}
    assert {f"p{i}" for i in range(100, 200)} <= maybe and len(maybe) < 130
    new = spark.createDataFrame([("surely new",)], "source_path string")
    assert store.may_know(new).collect() == [] and store.missing(new).count() == 1


def test_additions_are_parts_and_full_buckets_are_written_as_one(spark, stored):
    store, rows = stored
    for n in range(1, 4):
        store.add(spark.createDataFrame([(f"n{n}-{i}", f"n{n}-{i}", "x") for i in range(40)] + rows[:5], SCHEMA))
        assert store.read().count() == 200 + 40 * n
    per_bucket = [b for b, _, _, _ in store.parts()]
    assert max(per_bucket.count(b) for b in set(per_bucket)) < 3
    assert store.read().select("source_path").distinct().count() == 320


def test_commits_are_written_once(spark, stored):
    store, _ = stored
    rows = spark.createDataFrame([("a", "a", "a")], SCHEMA)
    store.add(rows, commit=4)
    version = store.version()
    store.add(spark.createDataFrame([("b", "b", "b")], SCHEMA), commit=4)
    assert (store.version(), store.last_commit(), store.read().count()) == (version, 4, 201)
    store.add(spark.createDataFrame([("b", "b", "b")], SCHEMA), commit=5)
    assert store.read().count() == 202


def test_removal(spark, stored):
    store, rows = stored
    store.remove(spark.createDataFrame([("p3",), ("p4",), ("unknown",)], "source_path string"))
    assert store.read().count() == 198
    store.remove(spark.createDataFrame([(p,) for _, p, _ in rows], "source_path string"))
    assert store.read().collect() == [] and store.missing(spark.createDataFrame([("p3",)], "source_path string")).count() == 1
    store.add(spark.createDataFrame(rows[:2], SCHEMA))
    assert store.read().count() == 2


def test_a_write_that_failed_leaves_nothing(spark, stored):
    store, _ = stored
    spark.createDataFrame([("x", "x", "x", 1)], SCHEMA + ", bucket int").write.partitionBy("bucket").parquet(f"{store.path}/data/version=2")
    assert store.read().count() == 200
    store.add(spark.createDataFrame([("y", "y", "y")], SCHEMA))
    assert store.read().count() == 201 and store.read().where("id = 'x'").count() == 0


def test_empty_store_and_nothing_to_write(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "none"), "k", "k long, v string")
    nothing = spark.createDataFrame([], "k long, v string")
    assert store.read().collect() == [] and store.version() == 0 and store.last_commit() is None
    for write in (store.add, store.remove):
        write(nothing)
    store.upsert(nothing, lambda old, new: new)
    assert store.version() == 0 and store.missing(spark.range(3).withColumnRenamed("id", "k")).count() == 3


def test_bloom_filter():
    rng = np.random.default_rng(0)
    keys, others = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 20_000)
    bits = bloom_bits(keys)
    assert may_hold(bits, keys).all() and may_hold(bits, others).mean() < 0.02 and len(bits) <= 10 * 5000 // 8 + 8


def test_ledger_batches_read_only_their_buckets(spark, tmp_path):
    from corpusflow.streaming import collect as C

    write, path = C.append_batch(str(tmp_path / "ledger")), str(tmp_path / "ledger")
    row = lambda i: (f"https://a.org/{i}", "s", "a.org", f"https://a.org/{i}", "t", "", True, "", False)
    batch = lambda ids: spark.createDataFrame([row(i) for i in ids], C.LEDGER_SCHEMA.rpartition(",")[0])
    write(batch(range(50)), 0)
    write(batch([*range(40, 60), 59]), 1)
    write(batch([100]), 1)  # a replay
    got = C.ledger(spark, path).groupBy("batch_id").agg(F.count("*").alias("n")).collect()
    assert {r["batch_id"]: r["n"] for r in got} == {0: 50, 1: 10}
