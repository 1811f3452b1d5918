import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm.divergence import _parts, block_result, source_divergence, term_counts
from corpusflow.llm.lexical import search
from corpusflow.llm.mixing import in_ranges, mix, running

COLUMNS = "doc_id long, text string, lang string, source string, rank string, score double, n string, term string"


@pytest.fixture(scope="module")
def corpus(llm_spark):
    """Small documents in two languages and a third without kept terms; null columns, repeated rows, a group without terms."""
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(300):
        text = " ".join(words[int(x)] for x in rng.zipf(1.3, rng.integers(0, 40)) % 60)
        lang, source = ("en", None, "de")[i % 3], (None, "b", "ß", "B", "hot", "hot", "hot")[int(rng.integers(7))]
        rows.append((i // 2, text if i % 17 else None, lang, source))
    rows += [(1000, "Wa Wa, WAA-wa 12 token", "en", "b")] * 3 + [(None, "wa wb", "en", "hot"), (2000, "123 ...", "en", "empty"), (2001, "rare words alone", "xx", "one"), (2002, None, "xx", "two")]
    return rows, llm_spark.createDataFrame([(*r, "r", 0.1, "n", "t") for r in rows], COLUMNS)


@pytest.fixture(scope="module")
def no_rows(llm_spark):
    return llm_spark.createDataFrame([], COLUMNS)


def brute_divergence(rows, min_docs, add=5, top=50):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")) for _, text, lang, source in rows]
    docs = [(lang, source, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in found]) for lang, source, found in docs]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(w for d in docs if d[0] == lang for w in set(d[2]))
        kept = {w for w, n in df.items() if n >= min_docs}
        counts = defaultdict(Counter)
        for d in docs:
            if d[0] == lang:
                counts[d[1]].update(w for w in d[2] if w in kept)
        p = {s: {w: 1 + 10**9 * (c[w] + add) // (sum(c.values()) + add * len(kept)) for w in kept} for s, c in counts.items()}
        whole = sum(counts.values(), Counter())
        q = {w: 1 + 10**9 * (whole[w] + add) // (sum(whole.values()) + add * len(kept)) for w in kept}
        for s in p:
            pairs = [(-sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in p if o != s]
            terms = [(q[w] - p[s][w], w) for w in kept if counts[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, item) in enumerate(found, 1)]
    return Counter(out)


@pytest.mark.parametrize(("min_docs", "top", "block", "width"), [(30, 50, 250_000, 512), (5, 3, 40, 2), (1, 4, 7, 1)])
def test_divergence_against_brute_force(corpus, min_docs, top, block, width):
    rows, docs = corpus
    got = source_divergence(docs, min_docs=min_docs, top=top, block_postings=block, width=width)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    assert Counter(map(tuple, got.collect())) == brute_divergence(rows, min_docs, top=top)


def test_divergence_of_nothing(no_rows):
    assert source_divergence(no_rows).collect() == []


def test_counts_are_the_same_however_often_they_are_handed_on(corpus):
    docs = corpus[1].select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    assert Counter(map(tuple, term_counts(docs, held=10).collect())) == Counter(map(tuple, term_counts(docs).collect()))


def test_parts_beyond_64_bits():
    count, total = np.array([5, 10**14, 3 * 10**15, 4 * 10**15]), np.array([7, 10**15 + 7, 3 * 10**15 + 1, 4 * 10**15])
    assert _parts(count, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(count, total, strict=True)]


def test_scatter_in_small_steps():
    rng = np.random.default_rng(1)
    post = sorted({(f"s{rng.integers(9)}", f"t{rng.integers(40)}") for _ in range(200)})
    left = pa.table({"source": [s for s, _ in post], "term": [t for _, t in post], "n": rng.integers(1, 50, len(post)), "lang_n": [900] * len(post)})
    right = pa.table({"source": [f"s{i}" for i in range(9)], "total": [1000] * 8 + [3], "v": [40] * 9, "lang_total": [8003] * 9})
    assert list(block_result(left, right, 5, 4, 0, 512, scatter=7)) == list(block_result(left, right, 5, 4, 0, 512))


def brute_search(docs, items, k):
    cut = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    words = [(i, cut(t)) for i, t in docs]
    n, length, df = sum(bool(w) for _, w in words), sum(len(w) for _, w in words), Counter(x for _, w in words for x in set(w))
    out = []
    for item, text in items:
        found = []
        for doc_id, w in words:
            tf, m = Counter(w), 50 + (50 * len(w) * n // length if w else 0)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in set(cut(text)) if tf[t])
            if s > 0:
                found.append((-s, math.inf if doc_id is None else doc_id, doc_id))
        out += [(item, rank, doc_id, -s) for rank, (s, _, doc_id) in enumerate(sorted(found, key=lambda x: x[:2])[:k], 1)]
    return Counter(out)


@pytest.mark.parametrize(("k", "owners", "bundle", "block", "chunk"), [(50, 4, 256, 16 << 20, 16_384), (3, 1, 2, 16 << 20, 20), (2, 5, 3, 300, 10), (7, 3, 1, 16 << 20, 50)])
def test_search_against_brute_force(corpus, llm_spark, k, owners, bundle, block, chunk):
    rows, docs = corpus
    asked = [(1, "wa wbé WCéé, zz 12"), (1, "wa wa"), (2, rows[40][1]), (3, None), (4, "nowhere"), (None, rows[3][1]), (5, rows[9][1]), (5, rows[9][1]), (6, "Wa-wa")]
    items = llm_spark.createDataFrame([(i, t, 1, "x") for i, t in asked], "item_id long, text string, doc_id int, score string")
    got = search(docs, items, k, owners, bundle, block, chunk)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert Counter(map(tuple, got.collect())) == brute_search([(r[0], r[1]) for r in rows], asked, k)


def test_search_over_the_given_documents_prunes_nothing_wanted(llm_spark, sf, documents):
    items = llm_spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_search([tuple(r) for r in documents.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()], 5)
    assert Counter(map(tuple, search(documents, items, 5, owners=6, bundle_items=7, chunk_docs=64).collect())) == want


def test_search_without_documents_or_items(corpus, llm_spark, no_rows):
    items = llm_spark.createDataFrame([(1, "wa")], "item_id long, text string")
    assert search(no_rows, items).collect() == []
    assert search(corpus[1], items.where("false")).collect() == []
    assert search(corpus[1], llm_spark.createDataFrame([(1, None), (2, " .")], "item_id long, text string")).collect() == []


def fair_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) >= 2 * sizes[s]}
        if not full:
            target.update({s: left * weight[s] / sum(weight[o] for o in open_) for s in open_})
            break
        target.update({s: 2 * sizes[s] for s in full})
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix(corpus):
    rows, docs = corpus
    got = mix(docs)
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    out = got.collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, mix(docs.repartition(5)).collect()))  # reruns agree
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in out) == Counter((i, size(t)) for i, t, _, _ in rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    target = fair_targets(sizes)
    assert Counter((r["source_size"], round(r["target"], 6)) for r in out) == Counter((sizes[s], round(target[s], 6)) for _, _, _, s in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    assert sum(r["taken"] for r in out) == 3 * sum(sizes.values()) // 2
    longest = max(r["size"] for r in out)
    for goal, whole in {(target[s], sizes[s]) for s in sizes}:
        took = sum(r["taken"] for r in out if r["source_size"] == whole and abs(r["target"] - goal) < 1e-6)
        of = sum(1 for s in sizes if sizes[s] == whole and abs(target[s] - goal) < 1e-6)
        assert abs(took - of * goal) <= of * 2 * longest


def test_mix_of_odd_tables(llm_spark, no_rows):
    assert mix(no_rows).collect() == []
    rows = [(1, None, "en", "a"), (1, "", "en", "a"), (None, " \t", None, None)]
    assert {tuple(r) for r in mix(llm_spark.createDataFrame([(*r, "r", 0.1, "n", "t") for r in rows], COLUMNS)).collect()} == {(1, 0, 0, 0.0, 0), (None, 0, 0, 0.0, 0)}
    one = mix(llm_spark.createDataFrame([(i, "a b c", "en", None, "r", 0.1, "n", "t") for i in range(4)], COLUMNS)).collect()
    assert sum(r["taken"] for r in one) == 18 and {r["target"] for r in one} == {18.0} and max(r["taken"] for r in one) == 6


def test_mix_uses_no_python_workers(corpus):
    plan = mix(corpus[1])._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_running_sums_over_ranges(llm_spark):
    rows = [(i % 3 or None, i * 7 % 50, i) for i in range(100)]
    df = llm_spark.createDataFrame(rows, "key int, at int, value long")
    order = [F.col("key").asc_nulls_last(), F.col("at"), F.col("value")]
    got = {tuple(r) for r in running(in_ranges(df, order, "test"), "value", order, ["key"], "before").select("key", "at", "value", "before").collect()}
    assert got == {(k, a, v, sum(x for j, b, x in rows if j == k and (b, x) < (a, v))) for k, a, v in rows}
