"""Token ids of whole texts by the ``tokenizers`` library, each distinct word of a task encoded once.

Texts are cut before a blank that has no white space on either side, and a word of letters is
cut from ASCII punctuation after it, if it is still one after the tokenizer's normalisation (some
letters come apart into a letter and a mark, which stays with the punctuation). The vocabularies here split words at such places in any
case (a token never reaches over them), so the ids of the pieces, put together, are the ids of
the text. Apostrophes are left alone, since they may belong to a contraction. A text that spells one of the
tokenizer's added tokens goes to the library as a whole, which gives that token's id.
"""

from __future__ import annotations

import re
import string
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Where a text may be cut if blanks stand beside other white space or at its ends.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_PUNCTUATION = string.punctuation.replace("'", "")
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _uneven(words: pa.Array) -> np.ndarray:
    """Whether each word is empty or has white space at its ends, so that the cut before its blank isn't safe."""
    return pc.or_(pc.not_equal(pc.utf8_trim(words, _SPACES), words), pc.equal(words, "")).to_numpy(zero_copy_only=False)


class WordEncoder:
    """Encodes texts with a bounded memory of words already seen.

    Words are split, numbered and looked up by Arrow, a batch of texts at once; only words that are new reach
    the library. ``memory`` bounds the bytes that remembered words and their ids take; beyond it they are forgotten.
    """

    def __init__(self, path: str, memory: int = 160 << 20):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.memory = memory
        self.tails: dict[str, bytes] = {}
        # a number between words of letters is one id, which no letters give
        self.between = self.tokenizer.encode(" 0", add_special_tokens=False).ids
        self._forget()

    @property
    def width(self) -> int:
        return 2 if self.code == "H" else 4

    def _forget(self) -> None:
        self.words, self.ids = pa.array([], pa.string()), pa.array([], pa.binary())
        self.tails.clear()

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: pa.Array) -> np.ndarray:
        """Whether each word is all letters, as it is and normalised."""
        found = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False).copy()
        if self.tokenizer.normalizer is not None:
            for i in np.flatnonzero(found & ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False)).tolist():
                found[i] = self.tokenizer.normalizer.normalize_str(words[i].as_py()).isalpha()
        return found

    def _of_letters(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, each as it is after a blank."""
        out: list[bytes] = []
        texts = [" " + " 0 ".join(words[at : at + 1000]) + " 0" for at in range(0, len(words), 1000)]
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(found.ids, f"<u{self.width}")
            ends = np.flatnonzero(ids == self.between[0])
            raw, starts = ids.tobytes(), np.concatenate(([0], ends[:-1] + 1)) * self.width
            out += [raw[a:b] for a, b in zip(starts.tolist(), (ends * self.width).tolist(), strict=True)]
        return out

    def _any(self, words: list[str]) -> list[bytes]:
        """The ids of words without white space at their ends, each as it is after a blank."""
        out: list[bytes] = []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            found = self.tokenizer.encode(" " + " ".join(some), add_special_tokens=False)
            ids = array(self.code, found.ids)
            cuts = np.searchsorted([start for start, _ in found.offsets], np.cumsum([len(w) + 1 for w in some])).tolist()
            out += [ids[start:end].tobytes() for start, end in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _learn(self, words: pa.Array, cores: pa.Array, known: np.ndarray) -> list[bytes]:
        """The ids of new words without white space at their ends. ``cores`` are the words without the punctuation after them,
        ``known`` the places of cores that are remembered (-1: none)."""
        letters = self._letters(cores) & (len(self.between) == 1)
        ended = letters & pc.not_equal(cores, words).to_numpy(zero_copy_only=False)
        fresh = pc.unique(cores.filter(pa.array(letters & (~ended | (known < 0))))).to_pylist()
        ids = dict(zip(fresh, self._of_letters(fresh), strict=True))
        other = words.filter(pa.array(~letters)).to_pylist()
        ids.update(zip(other, self._any(other), strict=True))
        remembered = self.ids.take(pa.array(known, pa.int32(), mask=known < 0)).to_pylist()
        whole, parts = words.to_pylist(), cores.to_pylist()
        tails = {whole[i][len(parts[i]) :] for i in np.flatnonzero(ended).tolist()}
        if new := list(tails.difference(self.tails)):
            self.tails.update(zip(new, self._alone(new), strict=True))
        out = []
        for word, core, end, old in zip(whole, parts, ended.tolist(), remembered, strict=True):
            if end:
                out.append((ids[core] if old is None else old) + self.tails[word[len(core) :]])
            else:
                out.append(ids[word])
        return out

    def _after_blanks(self, distinct: pa.Array, codes: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The ids of runs of words, as many each as ``counts`` says; words are given by their places among
        ``distinct`` ones, and no word has white space at its ends."""
        used = np.bincount(codes, minlength=len(distinct)) > 0
        place = np.cumsum(used) - 1
        distinct = distinct.filter(pa.array(used))
        if self.words.nbytes + self.ids.nbytes + 2 * distinct.nbytes > self.memory:
            self._forget()
        cores, n = pc.utf8_rtrim(distinct, _PUNCTUATION), len(distinct)
        at = pc.fill_null(pc.index_in(pa.concat_arrays([distinct, cores]), self.words), -1).to_numpy()
        at, core_at, new = at[:n].copy(), at[n:], at[:n] < 0
        if new.any():
            words = distinct.filter(pa.array(new))
            ids = self._learn(words, cores.filter(pa.array(new)), core_at[new])
            at[new] = len(self.words) + np.arange(len(words))
            self.words, self.ids = pa.concat_arrays([self.words, words]), pa.concat_arrays([self.ids, pa.array(ids, pa.binary())])
        found = self.ids.take(pa.array(at[place[codes]]))
        starts = np.frombuffer(found.buffers()[1], np.int32)[found.offset :][np.concatenate(([0], np.cumsum(counts)))].tolist()
        raw = found.buffers()[2].to_pybytes() if starts[-1] else b""
        return [raw[a:b] for a, b in zip(starts, starts[1:])]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned integers of ``width`` bytes, as the library's plain call gives them."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        if not len(texts):
            return []
        cut = pc.split_pattern(texts, " ")
        begins = cut.offsets.to_numpy()
        words, counts = cut.flatten(), np.diff(begins)
        begins = begins[:-1] - begins[0]
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        uneven = _uneven(coded.dictionary)[codes]
        # a text goes by its words if each, but the first of a text with no other, is even
        odd = np.logical_or.reduceat(uneven, begins) & ((counts > 1) | (words.take(pa.array(begins)).to_numpy(zero_copy_only=False) != ""))
        spelt = np.array([self.added.search(t) is not None for t in texts.to_pylist()]) if self._may_spell(texts) else np.zeros(len(texts), bool)
        rest = np.ones(len(words), bool)
        rest[begins] = False
        rest &= np.repeat(~(odd | spelt), counts)
        firsts = words.take(pa.array(begins)).to_pylist()
        runs = np.where(odd | spelt, 0, counts - 1)
        tails = [[] for _ in range(len(texts))]
        for i in np.flatnonzero(odd & ~spelt).tolist():
            pieces = _CUT.split(texts[i].as_py())
            if len(pieces) > 1 and (last := pieces[-1][1:]) != last.strip():
                pieces[-2:] = [pieces[-2] + " " + last]
            firsts[i], tails[i] = pieces[0], [w[1:] for w in pieces[1:]]
        for i in np.flatnonzero(spelt).tolist():
            firsts[i] = texts[i].as_py()
        after = self._after_blanks(coded.dictionary, codes[rest], runs)
        if odd.any():
            coded = pa.array([w for t in tails for w in t], pa.string()).dictionary_encode()
            more = self._after_blanks(coded.dictionary, coded.indices.to_numpy(), np.array([len(t) for t in tails]))
            after = [a + b for a, b in zip(after, more, strict=True)]
        return [first + a for first, a in zip(self._alone(firsts), after, strict=True)]

    def _may_spell(self, texts: pa.Array) -> bool:
        return any(pc.any(pc.match_substring(texts, t.content)).as_py() for t in self.tokenizer.get_added_tokens_decoder().values())


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The Python worker's encoder: tasks that run in it one after the other go on with its words."""
    return WordEncoder(path)
