"""Keys on which two texts meet if their Ratcliff–Obershelp ratio can reach a given one: arrays of numpy, a text a column.

Of two texts at the ratio at most ``u`` characters, of both together, are without a partner ("strays"). The one is cut
into ``h`` segments, ``2 h > u``, and each stray is put to one of them. Of the segments up to which there are at most two
strays a segment less one, the first has one stray at most, and ``2 i`` or ``2 i + 1`` before it, so at most ``u - 2 i`` after
it. With none it stands whole in the other text; with one of its own, it does without that character; with one of the
other text's, a window of the other text does without a character inside it. That is near the segment's own place, counted
from the nearer end. So keys are twice as long as with segments that have to be whole. Texts too short for that are cut into
``u + 1`` segments, of which one is whole, and still shorter ones into characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property
from math import floor

import numpy as np

#: A key's ways to meet: whole segments, segments less a character.
WHOLE, LESS = 0, 1
#: Characters (of all texts) worked on at once.
CHUNK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_ODD = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> _HALF
    h *= _ODD
    h ^= h >> _HALF
    h *= _ODD
    h ^= h >> _HALF
    return h


def _coarse(h: int) -> int:
    """``h`` or a little more: long texts have few numbers of segments."""
    step = 1 << max(0, h.bit_length() - 5)
    return -(-h // step) * step


class Filter:
    """Bits of keys, two a key; a key that isn't there passes now and then."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.size = bits, (8 * len(bits)).bit_length() - 1

    def passing(self, keys: np.ndarray) -> np.ndarray:
        found = self._marked(_first(keys, self.size))
        at = np.nonzero(found)
        found[at] = self._marked(_second(keys[at], self.size))
        return found

    def _marked(self, slot: np.ndarray) -> np.ndarray:
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _first(keys: np.ndarray, size: int) -> np.ndarray:
    return keys >> np.uint64(64 - size)


def _second(keys: np.ndarray, size: int) -> np.ndarray:
    return keys & np.uint64((1 << size) - 1)


def slots(keys: np.ndarray, size: int) -> np.ndarray:
    """Places of keys in a filter of ``2 ** size`` bits."""
    return np.concatenate([_first(keys, size), _second(keys, size)]).astype(np.int64)


class Keys:
    """Keys of cut texts and of the texts they are looked for in, whose lengths are known."""

    def __init__(self, min_ratio: float, cut: Iterable[int], sought: Iterable[int]) -> None:
        self.min_ratio, self.cut_lengths, self.sought_lengths = min_ratio, sorted(cut), sorted(sought)
        self._cuts: dict[int, list] = {}

    @cached_property
    def _powers(self) -> list[np.uint64]:
        longest = max([0, *self.cut_lengths, *self.sought_lengths]) + 2
        return [np.uint64(pow(_BASE, k, 1 << 64)) for k in range(longest)]

    def strays(self, n: int, m: int) -> int:
        return floor((1 - self.min_ratio) * (n + m) + 1e-9)

    def _partners(self, n: int, lengths: list[int]) -> list[int]:
        reach = (2 - self.min_ratio) / self.min_ratio
        return [m for m in lengths if max(n, m) <= floor(min(n, m) * reach + 1e-9)]

    def way(self, n: int, m: int) -> tuple[int, int]:
        """Strays a segment may have, and number of segments, of a text of ``n`` characters looked for in one of ``m``."""
        u = self.strays(n, m)
        one, none = _coarse((u + 2) // 2), _coarse(u + 1)
        if u and n // one >= 2:
            return 1, one
        return (0, none) if n >= none else (-1, n)

    def cuts(self, n: int) -> list[tuple]:
        """``(way, by_start, place, leeway, begin, size)`` of each segment."""
        if n not in self._cuts:
            most: dict[tuple[int, int], int] = {}
            for m in self._partners(n, self.sought_lengths):
                way = self.way(n, m)
                most[way] = max(most.get(way, 0), self.strays(n, m))
            found = self._cuts[n] = []
            for (allowed, h), u in most.items():
                for i in range(h):
                    begin = i * n // h
                    size = (i + 1) * n // h - begin
                    if allowed < 0:
                        found.append(((-1, 0), True, 0, 0, begin, size))
                        continue
                    before, after = (allowed + 1) * i + allowed, u - (allowed + 1) * i
                    by_start = before <= after
                    if after >= 0:
                        found.append(((allowed, h), by_start, begin if by_start else n - begin - size, min(before, after), begin, size))
        return self._cuts[n]

    @staticmethod
    def _band(way: tuple[int, int]) -> int:
        return max(8, (way[0] + 1) * way[1] // 2)

    @staticmethod
    def _salt(way: tuple[int, int], by_start: bool, kind: int, band: np.ndarray) -> np.ndarray:
        seed = np.uint64(((way[0] + 1) << 40 | way[1] << 8 | by_start << 1 | kind) * _BASE % (1 << 64))
        return _mixed(seed + band.astype(np.uint64))[:, None]

    def _prefixes(self, text: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(text) + 1, text.shape[1]), np.uint64)
        base = self._powers[1]
        for k, row in enumerate(text):
            sums[k + 1] = sums[k] * base + row
        return sums

    def count(self, n: int) -> int:
        """Keys of whole segments of a text of ``n`` characters."""
        return sum((place + leeway) // self._band(way) - max(0, place - leeway) // self._band(way) + 1 for way, _, place, leeway, _, _ in self.cuts(n))

    def of_cut(self, text: np.ndarray, less: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of texts that are cut, with the columns they are from. ``text``: characters (bytes) by place and text."""
        sums, power, n = self._prefixes(text), self._powers, len(text)
        alike: dict[tuple, list] = {}
        for way, by_start, place, leeway, begin, size in self.cuts(n):
            band = self._band(way)
            alike.setdefault((way, by_start, size), []).extend((begin, b) for b in range(max(0, place - leeway) // band, (place + leeway) // band + 1))
        column = np.arange(text.shape[1])
        for (way, by_start, size), placed in alike.items():
            at, band = np.array(placed).T
            whole = sums[at + size] - sums[at] * power[size] + self._salt(way, by_start, WHOLE, band)
            yield np.broadcast_to(column, whole.shape).ravel(), _mixed(whole).ravel()
            if way[0] != 1 or not less:
                continue
            salt = self._salt(way, by_start, LESS, band)
            for j in range(size):
                head, rest = sums[at + j] - sums[at] * power[j], size - 1 - j
                key = _mixed(head * power[rest] + (sums[at + size] - sums[at + j + 1] * power[rest]) + salt)
                # of a run of the same character, the last
                where = np.nonzero(text[at + j] != text[at + j + 1]) if rest else np.nonzero(np.ones(key.shape, bool))
                yield where[1], key[where]

    def of_sought(self, text: np.ndarray, whole: Filter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of texts in which segments are looked for; those of whole segments, if the filter has them."""
        sums, power, m = self._prefixes(text), self._powers, len(text)
        places: dict[tuple, tuple[int, int]] = {}
        for n in self._partners(m, self.cut_lengths):
            wanted = self.way(n, m)
            for way, by_start, place, leeway, _, size in self.cuts(n):
                if way == wanted or way[0] == wanted[0] == -1:
                    low, high = places.get((way, by_start, size), (place, place))
                    places[way, by_start, size] = min(low, place - leeway), max(high, place + leeway)
        for (way, by_start, size), (low, high) in places.items():
            for window, kind in ((size, WHOLE), (size + 1, WHOLE), (size - 1, LESS))[: 3 if way[0] == 1 else 1]:
                first, last = (low, high) if by_start else (m - window - high, m - window - low)
                if way[0] == -1:
                    first, last = 0, m
                at = np.arange(max(0, first), min(last, m - window) + 1)
                if not len(at):
                    continue
                place = np.zeros_like(at) if way[0] == -1 else at if by_start else m - window - at
                salt = self._salt(way, by_start, kind, place // self._band(way))
                rows = lambda k: sums[at[0] + k : at[-1] + k + 1]  # noqa: E731, B023
                if window != size + 1:
                    key = _mixed(rows(window) - rows(0) * power[window] + salt)
                    where = np.nonzero(whole.passing(key) if kind == WHOLE else np.ones(key.shape, bool))
                    yield where[1], key[where]
                    continue
                for j in range(1, size):
                    rest = size - j
                    key = _mixed((rows(j) - rows(0) * power[j]) * power[rest] + (rows(window) - rows(j + 1) * power[rest]) + salt)
                    passed = whole.passing(key)
                    if j < size - 1:
                        passed &= text[at[0] + j : at[-1] + j + 1] != text[at[0] + j + 1 : at[-1] + j + 2]
                    where = np.nonzero(passed)
                    yield where[1], key[where]


def by_length(texts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of texts of one length, and their characters by place and text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(lengths, kind="stable")
    for same in np.split(order, np.nonzero(np.diff(lengths[order]))[0] + 1):
        n = int(lengths[same[0]]) if len(same) else 0
        for start in range(0, len(same) if n else 0, step := max(1, CHUNK // max(1, n))):
            part = same[start : start + step]
            letters = np.frombuffer("".join(texts[part]).encode("ascii"), np.uint8).reshape(len(part), n)
            yield part, np.ascontiguousarray(letters.T)


def gathered(parts: Iterable[tuple[np.ndarray, np.ndarray]], rows: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Columns and keys put together to about ``rows`` rows."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[1])
        if size >= rows:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


def sketches(text: np.ndarray) -> list[np.ndarray]:
    """How often a text has each character: fifteen counts a number, up to seven each; of common ones also what is beyond."""
    counts = [(text == c).sum(0) for c in b" abcdefghijklmnopqrstuvwxyz"]
    counts.append((text >= ord("0")).sum(0) - (text >= ord("a")).sum(0))
    counts += [(text == c).sum(0) - 7 for c in b" acdeghilmnoprstu"]
    lanes = [np.clip(c, 0, 7) << 4 * (k % 15) for k, c in enumerate(counts)]
    return [sum(lanes[k : k + 15]).astype(np.int64) for k in (0, 15, 30)]
