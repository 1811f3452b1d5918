import hashlib
import math
from collections import Counter

import numpy as np
import pytest

from corpusflow.llm import vantage, warc
from corpusflow.llm.queries import QUERIES
from corpusflow.llm.url_rules import judge_urls
from corpusflow.session import scratch_dir


def reference_verdict(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[2:] if fits else (None, default)
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://NET/", "https://a.net", "https://a.net/x", "http://Example.NET/en/", "http://example.net/en", "http://w.example.net/en/x?y#z",
    "http://example.com/de/1", "http://badexample.com/de/1", "http://example.com.org/fr/", "ftp://x.org/fr/://y", "http://org/fr/", "http://a.org:80/fr/", "http://a,b.net/",
    "http://é.org/fr/é", "http://x.net/a\nb", "://net/", "http://.net/", "http://a..net/en/",
]
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("b.net", "/", "allow"), ("w.example.net", "/en/x", "block"), ("w.example.net", "/en/x", "allow"), (None, "/", "block")]


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_url_rules(llm_spark, ranges):
    rows = [(i, u, "rule", "host") for i, u in enumerate(URLS)] + [(None, URLS[5], "", ""), (3, URLS[3], "", ""), (3, URLS[3], "", "")]
    pages = llm_spark.createDataFrame(rows, "page_id long, url string, rule string, host string")
    rules = llm_spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = Counter(tuple(r) for r in judge_urls(pages, rules, ranges=ranges).collect())
    assert got == Counter((i, *reference_verdict(u, RULES)) for i, u, *_ in rows)
    assert judge_urls(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_hot_hosts_are_many_ranges(llm_spark):
    pages = llm_spark.range(3000).selectExpr("id as page_id", "if(id % 2 = 0, 'http://hot.example.net/en/x', concat('http://h', id, '.example.org/fr/', id)) as url")
    rules = llm_spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = judge_urls(pages, rules, ranges=16).collect()
    assert all(tuple(r)[1:] == reference_verdict(f"http://{r['host']}{r['path']}", RULES) for r in got) and len(got) == 3000


# archives


def reference_records(rows):
    firsts, out = {}, []
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    for i in order:
        page_id, _, html = rows[i]
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        if len(payload) >= 100 and digest in firsts:
            out.append((page_id, len(payload), digest, "revisit", firsts[digest]))
        else:
            out.append((page_id, len(payload), digest, "response", None))
            if len(payload) >= 100 and page_id is not None:
                firsts[digest] = page_id
    return Counter(out)


PAGES = [
    (1, "http://a.org/x", "short"), (2, "http://a.org/x", "short"), (5, "http://A.org/x", "é" * 60), (3, None, "é" * 60), (4, "no scheme", "é" * 60), (4, "no scheme", "é" * 60),
    (6, "http://b.org/", None), (7, "", ""), (None, "http://b.org/", "é" * 60), (8, "http://c.org/a b\r\nc\tä", "<p>\r\n\r\n</p>" * 30), (9, "http://big.org/", "x" * 300_000), (10, "http://big.org/", "y" * 99), (11, "http://big.org/", "y" * 99), (12, "http://z.org/", "WARC/1.1\r\n\r\n" * 20),
]


def test_op3_against_brute_force(llm_spark, sf):
    rows = [tuple(r) for r in llm_spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert Counter(tuple(r) for r in QUERIES["op3_warc_index"](llm_spark, sf).collect()) == reference_records(rows)


def test_archive_edge_cases(llm_spark):
    pages = llm_spark.createDataFrame([(*p, "digest", 1) for p in PAGES], "page_id long, url string, html string, digest string, size int")
    assert Counter(tuple(r) for r in warc.archive_and_read_back(pages).collect()) == reference_records(PAGES)
    assert warc.archive_and_read_back(pages.limit(0)).collect() == []


def test_captures_are_found_by_key(llm_spark):
    pages = llm_spark.range(3000).selectExpr("id as page_id", "if(id % 3 = 0, 'http://hot.org/same', concat('http://h', id % 50, '.org/', id)) as url", "concat('<p>', id) as html")
    folder = scratch_dir(llm_spark, "test-archives")
    captures = warc.write_archives(pages, folder)
    index = warc.build_capture_index(captures, folder, block_lines=37)
    assert len(index.files) > 1 and list(index.firsts) == sorted(index.firsts)
    wanted = llm_spark.createDataFrame([("org,hot)/same",), ("org,hot)/same",), ("org,h7)/7",), ("org,h7)/none",), ("",), (None,), ("zz",)], "key string")
    found = warc.find_captures(index, wanted).collect()
    assert Counter(r["key"] for r in found) == {"org,hot)/same": 1000, "org,h7)/7": 1}
    read = warc.read_records(warc.find_captures(index, wanted)).collect()
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in read} == {(i, f"<p>{i}") for i in [*range(0, 3000, 3), 7]}


# nearest neighbours


def brute_neighbours(ids, vectors, queries, k):
    norms = np.sqrt([math.fsum(v * v) for v in vectors])
    out = []
    for q in queries:
        i = ids.index(q)
        scores = [(-float(math.fsum(v * vectors[i]) / (norms[j] * norms[i])), ids[j]) for j, v in enumerate(vectors) if j != i]
        out += [(q, r + 1, c) for r, (s, c) in enumerate(sorted((round(s, 12), c) for s, c in scores)[:k])]
    return set(out)


def test_search_is_exact_at_factor_one_and_good_beyond(llm_spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = (centres[rng.integers(12, size=1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    vectors[100:400] = vectors[100]  # a large group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = llm_spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_neighbours(list(range(1500)), vectors.astype(float), range(0, 1500, 50), 5)
    monkeypatch.setattr(vantage, "LEAF", 8)
    usable = vantage.usable_vectors(table)
    index = vantage.build_index(usable, shard_rows=400)
    exact = vantage.nearest(index, usable.where("vec_id % 50 = 0"), 5).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in exact} == want
    relaxed = vantage.nearest(index, usable.where("vec_id % 50 = 0"), 5, factor=1.5).collect()
    hit = {(q, c) for q, _, c in want} & {(r["query_id"], r["vec_id"]) for r in relaxed}
    assert len(hit) / len(want) > 0.9


def test_rows_with_one_id_are_all_candidates(llm_spark):
    table = llm_spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [0.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = vantage.nearest_neighbours(table, vantage.F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 2, 1] and got[0]["score"] > 0.99


def test_a_larger_factor_visits_less():
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(4000, 4))
    tree = vantage.Tree.build(np.arange(4000), vectors)
    seen = []

    def count(queries, some, real=vantage._cosines):
        seen.append(len(queries) * len(some))
        return real(queries, some)

    def work(factor):
        seen.clear()
        tree.search(np.array([-1]), vectors[:1] + 0.01, 5, factor)
        return sum(seen)

    real, vantage._cosines = vantage._cosines, count
    try:
        assert work(8.0) <= work(1.0) < 3000
    finally:
        vantage._cosines = real


def test_vectors_that_take_no_part(llm_spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (50, [2.0, 0.0]), (50, [2.0, 0.0]), (7, [1.0, 1.0]), (8, [])]
    table = llm_spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = vantage.nearest_neighbours(table, vantage.F.col("vec_id") % 50 == 0).collect()
    own = [(50, 1, 0), (50, 2, 50), (50, 3, 7)]  # each of the two rows with id 50 is a query, and a candidate of the other
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted([(0, 1, 50), (0, 2, 50), (0, 3, 7), *own, *own])
    assert vantage.nearest_neighbours(table.limit(0), vantage.F.lit(True)).collect() == []
    assert vantage.nearest_neighbours(table.where("vec_id = 0"), vantage.F.lit(True)).collect() == []
