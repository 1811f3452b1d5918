import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F
from test_documents import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from corpusflow.llm import quality, secrets
from corpusflow.llm.common import materialise


def brute_pipeline(spark, sf):
    """The kept documents with their final texts, each stage done in the plainest way."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.learn_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if model.scores([r["text"] or ""])[0] >= 0.5]
    component = brute_components(rows, 80)
    scanner, out = secrets.Scanner().ready(), []
    for doc_id, text in rows:
        if component[doc_id] != doc_id:
            continue
        clean, at = "", 0
        for kind, start, end in scanner.spans(text):
            if start >= at:
                clean += f"{text[at:start]}[{kind}]"
            at = max(at, end)
        out.append((doc_id, clean + text[at:]))
    return out


def test_run_against_brute_force(llm_spark, sf):
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for doc_id, text in brute_pipeline(llm_spark, sf):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            want[doc_id, n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())] += 1
    got = corpus_pipeline.run(llm_spark, sf).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)


def test_stages_keep_the_columns(llm_spark, sf, documents):
    docs = documents
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(llm_spark, docs, sf), f"test-{name}")
        assert docs.dtypes == documents.dtypes and 0 < docs.count() <= before.count()
    assert docs.where("n_chars <> char_length(text)").count() == 0


def test_stages_on_odd_documents(llm_spark, sf, edge, nothing):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(llm_spark, nothing, sf)
        assert out.collect() == [] and (name == "packing" or out.columns == nothing.columns)
    docs = edge.withColumn("score_", F.lit(1))
    count = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(llm_spark, docs, sf), f"test-{name}")
        count[name] = Counter(r["doc_id"] for r in docs.collect())
        assert docs.columns == [*edge.columns, "score_"]
    assert count["quality"][1] == count["quality"][2] == count["quality"][3] == 1  # no text, nothing against it
    kept = count["near_dedup"]
    assert all(n == 1 for d, n in kept.items() if d is not None)
    assert kept[1] == kept[2] == kept[3] == 1  # empty documents aren't each other's copies
    assert not (kept[5] and kept[6]) and not (kept[7] and kept[8])
    assert all("token=abcdef12" not in (r["text"] or "") for r in docs.collect())
