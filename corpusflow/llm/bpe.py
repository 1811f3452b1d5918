"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. A block of a few megabytes of documents numbers its distinct words
and keeps each document as the sequence of these numbers, its pre-tokens by position. What is
shuffled is each block's words, dealt to pages by their digest: a word of the whole corpus belongs to one
page, where it is encoded once, and every block that asked for it gets its ids. The answers join the
block again, and documents are reassembled by position. Words of a page come as one row for each block,
so the commonest word is no more than any other, and a page can be as many as the corpus needs.

Blocks are cut from the input partitions in their order, once for the words and once for the sequences.
Both carry a digest of the block's words, and the join stops with an error should they differ.
"""

from __future__ import annotations

import base64
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import id_and_text, slices

BLOCK_BYTES = 16 << 20


_PUNCTUATION = string.punctuation.replace("'", "")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Block:
    """The distinct words of a few documents, numbered as they come."""

    def __init__(self, pattern):
        self.find = pattern.findall
        self.words: dict[str, int] = {}
        self.between_blanks: dict[str, bytes] = {}

    def _numbers(self, text: str) -> bytes:
        number = self.words.setdefault
        return array("I", [number(word, len(self.words)) for word in self.find(text)]).tobytes()

    def positions(self, text: str) -> bytes:
        """The text's pre-tokens by position, as numbers of 32 bits.

        Between blanks that have no white space beside them pre-tokens don't depend on what lies
        beyond, so such pieces are cut once in a block. The pattern is that of GPT-2's kind: letters with a
        blank before them, then runs of what is neither letter, digit nor white space.
        """
        first, *pieces = text.split(" ")
        known = self.between_blanks
        if pieces and (not first or first[-1].isspace()):
            return self._numbers(text)
        start, words = self._numbers(first), self.words
        number = words.setdefault
        for piece in pieces:
            if piece not in known:
                letters = piece.rstrip(_PUNCTUATION)
                if letters.isalpha():  # a blank and letters, and the punctuation after them, are a pre-token each
                    found = [number(" " + letters, len(words))]
                    if len(letters) < len(piece):
                        found.append(number(piece[len(letters) :], len(words)))
                    known[piece] = array("I", found).tobytes()
                elif not piece or piece[0].isspace() or piece[-1].isspace():
                    return self._numbers(text)
                else:
                    known[piece] = self._numbers(" " + piece)
        return start + b"".join(map(known.__getitem__, pieces))

    def digest(self) -> int:
        return zlib.crc32("\0".join(self.words).encode())


def _blocks(batches: Iterator[pa.RecordBatch], pattern: str, size: int = BLOCK_BYTES) -> Iterator[tuple[int, Block, list[tuple]]]:
    """Blocks of a task's documents: number, words, and (doc_id, positions) of each document."""
    import regex
    from pyspark import TaskContext

    compiled, number = regex.compile(pattern), TaskContext.get().partitionId() << 32
    block, documents, held = Block(compiled), [], 0
    for batch in slices(batches, rows=64, size=1 << 20):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            documents.append((doc_id, block.positions(text)))
            held += len(text)
        if held >= size:
            yield number, block, documents
            number, block, documents, held = number + 1, Block(compiled), [], 0
    if documents:
        yield number, block, documents


def _squeeze(numbers: np.ndarray) -> bytes:
    """32-bit numbers, byte planes apart, compressed: most of the upper bytes are equal."""
    import zstandard

    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _numbers(squeezed: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(squeezed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def encode(docs: DataFrame, ranks_path: str, pattern: str, pages: int | None = None) -> DataFrame:
    """``doc_id`` and ``ids``, those of the text by the ranks, each match of ``pattern`` by itself.

    A null text is an empty one; an empty text has no ids. Repeated rows give repeated rows, a null
    doc_id stays null, and a very long text is a block of its own. An empty table gives no rows.
    """
    pages = pages or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = id_and_text(docs)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for number, block, _ in _blocks(batches, pattern):
            raw = [w.encode() for w in block.words]
            page_of = np.array([zlib.crc32(w) % pages for w in raw], np.int64)
            order = np.argsort(page_of, kind="stable")
            cuts = np.searchsorted(page_of[order], np.arange(pages + 1))
            check, rows = block.digest(), []
            for page in range(pages):
                own = order[cuts[page] : cuts[page + 1]]
                if len(own):
                    words = [raw[i] for i in own.tolist()]
                    rows.append((number, page, check, len(raw), _squeeze(own), _squeeze(np.array([len(w) for w in words])), zstandard.compress(b"".join(words), 3)))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                names = ["block", "page", "digest", "words", "places", "lengths", "bytes"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        import zstandard

        ranks = read_ranks(ranks_path)
        word_ids = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        page, memo = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["page"] != page:
                    page, memo = row["page"], {}
                data, at, found, counts = zstandard.decompress(row["bytes"]), 0, [], []
                for length in _numbers(row["lengths"]).tolist():
                    word = data[at : at + length]
                    at += length
                    ids = memo.get(word)
                    if ids is None:
                        ids = memo[word] = array("I", word_ids(word.decode())).tobytes()
                    found.append(ids)
                    counts.append(len(ids) // 4)
                out = (row["block"], row["digest"], row["words"], row["places"], _squeeze(np.array(counts)), _squeeze(np.frombuffer(b"".join(found), "<u4")))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                names = ["block", "digest", "words", "places", "counts", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(out, kinds, strict=True)], names=names)

    def sequenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block, documents in _blocks(batches, pattern):
            check, n = block.digest(), len(block.words)
            for at in range(0, len(documents), 256):
                some = documents[at : at + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(some), pa.int64()),
                        pa.array([check] * len(some), pa.int64()),
                        pa.array([n] * len(some), pa.int64()),
                        pa.array([d for d, _ in some], pa.int64()),
                        pa.array([_squeeze(np.frombuffer(p, "<u4")) for _, p in some], pa.binary()),
                    ],
                    names=["block", "digest", "words", "doc_id", "positions"],
                )

    def assembled(documents: pa.Table, answers: pa.Table) -> pa.Table:
        if documents.num_rows == 0:
            raise RuntimeError("words of a block without its documents: the input changed between two reads")
        check, n = documents.column("digest")[0].as_py(), documents.column("words")[0].as_py()
        counts, starts, flat, base, seen = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0, 0
        for row in answers.to_pylist():
            if (row["digest"], row["words"]) != (check, n):
                raise RuntimeError("a block's words differ between two reads of the input")
            places, own, ids = _numbers(row["places"]), _numbers(row["counts"]).astype(np.int64), _numbers(row["ids"])
            counts[places], starts[places] = own, base + np.cumsum(own) - own
            flat.append(ids)
            base, seen = base + len(ids), seen + len(places)
        if seen != n:
            raise RuntimeError("words of a block are missing")
        flat = np.concatenate([*flat, np.empty(0, np.uint32)]).astype(np.int32)
        ids, ends = [], [0]
        for positions in documents.column("positions").to_pylist():
            word = _numbers(positions)
            n_of = counts[word]
            before = np.cumsum(n_of) - n_of
            ids.append(flat[np.repeat(starts[word] - before, n_of) + np.arange(int(n_of.sum()))])
            ends.append(ends[-1] + len(ids[-1]))
        column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
        return pa.table({"doc_id": documents.column("doc_id"), "ids": column})

    answers = (
        texts.mapInArrow(asked, "block long, page int, digest long, words long, places binary, lengths binary, bytes binary")
        .repartition(pages, "page").sortWithinPartitions("page")
        .mapInArrow(answered, "block long, digest long, words long, places binary, counts binary, ids binary")
    )
    documents = texts.mapInArrow(sequenced, "block long, digest long, words long, doc_id long, positions binary")
    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(assembled, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``: each id joined with the table of tokens' bytes, in order.

    The table is the vocabulary, so its size does not depend on the data. Null ids stay null.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = read_ranks(ranks_path)
        token = [b""] * (max(ranks.values()) + 1)
        for value, rank in ranks.items():
            token[rank] = value
        of = token.__getitem__
        for batch in batches:
            decoded = [None if ids.values is None else b"".join(map(of, ids.values.to_numpy(zero_copy_only=False).tolist())) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(join, ", ".join(f"`{c}` {kind}" for c, kind in encoded.dtypes) + ", decoded binary")
