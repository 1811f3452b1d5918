import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusflow.llm import bpe
from corpusflow.llm.packing import Plan, pack, pack_documents, patterns, pieces, plan_packing, sequences, slots
from corpusflow.llm.queries import QUERIES
from corpusflow.llm.token_files import read_token_files, token_files, write_token_files
from corpusflow.llm.tokens import WordEncoder
from corpusflow.session import scratch_dir

LETTERS = st.text(st.sampled_from(list("abzAB '’-.,!?0159\n\t  éßΣς́日 \x1c<|>")) | st.characters(exclude_categories=["Cs"]), max_size=60)


TEXT = st.lists(LETTERS | st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"]), min_size=1, max_size=3).map("".join) | LETTERS


def library(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda text: t.encode(text, add_special_tokens=False).ids


ENCODERS = {name: (WordEncoder(P.path(name)), library(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}


@pytest.mark.parametrize("name", sorted(ENCODERS))
@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_words_encode_as_their_text(name, texts):
    encoder, whole = ENCODERS[name]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [whole(t) for t in texts]


@pytest.mark.parametrize("name", sorted(ENCODERS))
def test_every_letter_before_punctuation(name):
    encoder, whole = ENCODERS[name]
    letters = [c for c in map(chr, range(0x80, 0x110000)) if c.isalpha()]
    texts = [" VALİLİĞİ.", " हिन्दी क़,", *(" " + " ".join(f"a{c}." for c in letters[i : i + 500]) for i in range(0, len(letters), 500))]
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
    assert [t for t, ids in zip(texts, got, strict=True) if ids != whole(t)] == []


@pytest.mark.parametrize("name", sorted(ENCODERS))
def test_spelt_tokens_are_the_tokens(name):
    encoder, whole = ENCODERS[name]
    texts = ["a <|endoftext|> b", "plain words", "<|startoftext|>a<|endoftext|>", "<|endoftext", "<|endoftext|>", ""]
    got = [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)]
    assert got == [whole(t) for t in texts] and len(got[4]) == 1


def test_encoder_forgets_within_its_bound():
    encoder = WordEncoder(P.path("byte_bpe_50k.json"), memory=2_000)
    texts = [" ".join(f"w{i}x{j}" for j in range(50)) for i in range(30)]
    whole = library("byte_bpe_50k.json")
    for t in texts:
        assert np.frombuffer(encoder.encode([t])[0], "<u2").tolist() == whole(t)
    assert 0 < len(encoder.words) <= 200


def check_plan(histogram, max_len):
    plan = plan_packing(histogram, max_len)
    lengths = np.repeat(np.arange(max_len + 1), histogram)
    ranks = np.concatenate([np.arange(n) for n in histogram]) if len(lengths) else lengths
    sequence, offset = slots(plan, lengths, ranks)
    by = {}
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths.tolist(), strict=True):
        by.setdefault(s, []).append((o, n))
    assert len(by) == plan.sequences
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= max_len
    return plan


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=120))
def test_plans_place_every_piece_without_gaps(lengths):
    histogram = np.bincount(lengths, minlength=33) if lengths else np.zeros(33, int)
    plan = check_plan(histogram, 32)
    # never worse than first-fit decreasing's bound
    assert plan.sequences <= 11 / 9 * -(-sum(lengths) // 32) * 1.25 + 1


def test_plan_does_not_grow_with_the_counts():
    rng = np.random.default_rng(3)
    histogram = np.bincount(np.minimum(rng.geometric(1 / 700, 5_000), 4096), minlength=4097)
    small, large = plan_packing(histogram), plan_packing(histogram * 10_000)
    assert isinstance(small, Plan) and len(large.rank) < 4 * len(small.rank)
    tokens = int((histogram * np.arange(4097)).sum())
    assert small.sequences <= -(-tokens // 4096) + 2
    assert large.sequences <= -(-tokens * 10_000 // 4096) * 1.0005
    assert large.pattern_sequences > large.sequences / 10  # most sequences hold more documents than a pattern has


def test_patterns_fill_a_sequence():
    histogram = np.zeros(101, int)
    histogram[[10, 20, 30, 60, 100]] = 5
    found = patterns(histogram, 100)
    assert (100,) in found and all(sum(p) == 100 and len(p) <= 4 for p in found)
    assert (60, 30, 10) in found and (60, 20, 10, 10) in found


def reference_pieces(rows, max_len=4096):
    encode, out = library("word_bpe_49k.json"), []
    for doc_id, text in rows:
        ids = [*encode(text or ""), 1]
        for n, at in enumerate(range(0, len(ids), max_len)):
            own = np.array(ids[at : at + max_len], "<u4")
            out.append((doc_id, n, at, len(own), zlib.crc32(own.tobytes())))
    return Counter(out)


def test_op2_against_the_tokenizer(llm_spark, sf, documents):
    rows = QUERIES["op2_best_fit_packing"](llm_spark, sf).collect()
    assert Counter(tuple(r)[:5] for r in rows) == reference_pieces((r["doc_id"], r["text"]) for r in documents.collect())
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(by) <= -(-sum(r["length"] for r in rows) // 4096) + 2


def test_packing_edge_cases(llm_spark, edge, nothing):
    path = P.path("word_bpe_49k.json")
    rows = pack_documents(edge, path, 1, max_len=64).collect()
    assert Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == reference_pieces([(r["doc_id"], r["text"]) for r in edge.collect()], 64)
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == len(rows)
    assert pack_documents(nothing, path, 1).collect() == []


def test_sequences_hold_the_documents(llm_spark, documents):
    path = P.path("word_bpe_49k.json")
    packed = pack_documents(documents.limit(40), path, 1, max_len=512, keep_ids=True)
    parts = {(r["doc_id"], r["piece"]): bytes(r["ids"]) for r in packed.collect()}
    for row in sequences(packed).collect():
        for span in row["spans"]:
            assert bytes(row["ids"])[4 * span["offset"] : 4 * (span["offset"] + span["length"])] == parts[span["doc_id"], span["piece"]]


def test_a_hot_length_is_ranked_in_parts(llm_spark):
    from corpusflow.llm.common import materialise

    rows = llm_spark.range(3000).selectExpr("id as doc_id", "0 as piece", "if(id % 3 = 0, id % 50 + 1, 7) as length")
    out = pack(materialise(rows, "test"), max_len=64, rows_at_once=100).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == 3000
    assert max(r["offset"] + r["length"] for r in out) <= 64


def reference_files(rows):
    encode, out, start = library("byte_bpe_50k.json"), [], 0
    for doc_id, text in rows:
        ids = np.array([*encode(text or ""), 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_op10_against_the_tokenizer(llm_spark, sf, documents):
    got = sorted(tuple(r) for r in QUERIES["op10_token_files"](llm_spark, sf).collect())
    assert got == reference_files(sorted((r["doc_id"], r["text"]) for r in documents.collect()))


def test_token_files_edge_cases(llm_spark, edge, nothing):
    out = token_files(edge, P.path("byte_bpe_50k.json"), 0, with_ids=True).collect()
    encode = library("byte_bpe_50k.json")
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == Counter((r["doc_id"], (*encode(r["text"] or ""), 0)) for r in edge.collect())
    out.sort(key=lambda r: r["start"])
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in out]
    assert keys == sorted(keys)
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))
    assert token_files(nothing, P.path("byte_bpe_50k.json"), 0).collect() == []


def test_shards_are_flat_files(llm_spark, documents):
    folder = scratch_dir(llm_spark, "test-tokens")
    manifest = write_token_files(documents, P.path("byte_bpe_50k.json"), 0, folder, shards=3)
    assert [s.base for s in manifest] == np.cumsum([0, *[s.tokens for s in manifest[:-1]]]).tolist()
    for s in manifest:
        path = s.path.removeprefix("file:")
        assert np.fromfile(f"{path}.tok", "<u2").size == s.tokens
        assert np.fromfile(f"{path}.off", "<i8")[-1] == s.tokens
    again = write_token_files(documents, P.path("byte_bpe_50k.json"), 0, folder, shards=3)  # written anew in place
    assert again == manifest
    assert read_token_files(llm_spark, manifest).count() == documents.count()


RANKS = P.path("byte_bpe_50k.tiktoken")


def tiktoken_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op9_against_tiktoken(llm_spark, sf, documents):
    encoding = tiktoken_encoding()
    want = set()
    for r in documents.collect():
        ids = encoding.encode_ordinary(r["text"])
        want.add((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op9_byte_bpe"](llm_spark, sf).collect()} == want


def test_bpe_edge_cases(llm_spark, edge, nothing):
    encoding = tiktoken_encoding()
    out = bpe.decode(bpe.encode(edge, RANKS, P.PATTERN), RANKS).collect()
    rows = edge.collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in out) == Counter((r["doc_id"], tuple(encoding.encode_ordinary(r["text"] or ""))) for r in rows)
    assert Counter((r["doc_id"], bytes(r["decoded"]).decode()) for r in out) == Counter((r["doc_id"], r["text"] or "") for r in rows)
    assert bpe.encode(nothing, RANKS, P.PATTERN).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=4))
def test_blocks_keep_pre_tokens_in_order(texts):
    import regex

    block = bpe.Block(regex.compile(P.PATTERN))
    positions = [np.frombuffer(block.positions(t), "<u4").tolist() for t in texts]
    words = list(block.words)
    assert [[words[i] for i in p] for p in positions] == [regex.findall(P.PATTERN, t) for t in texts]
