"""Fingerprints of fixed-length windows, vectorised over many texts at once.

A window is `width` consecutive units (words or bytes) of one text. Its anchor
is the gram of `gram` units with the least hash among those inside it, the
leftmost of equals, so equal windows have equal anchors at equal offsets.
Consecutive windows with one anchor form a run; only runs leave this module:

  a   hash of the anchor gram
  c   hash of the run's whole content, with the anchor's place in it
  lo, hi, at   first and last window start of the run, and the anchor's place

Any window that occurs twice lies in two runs of equal a, and two runs of equal
(a, c) consist of equal windows throughout. That leaves a few hundredths of the
windows to shuffle while every repeat is still found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import mix64, slices

#: Units worked through at once; a worker's arrays are a few times that many words of 8 bytes.
SLICE = 250_000
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        grown = np.full(max(n, 2 * SLICE), base, _U)
        grown[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(grown)
    return known[:n]


def segment_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of values[start:end] for each pair, wherever the segment stands."""
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values * _power(_BASE, len(values)), out=total[1:])
    return mix64((total[end] - total[start]) * _power(_INVERSE, len(values) + 1)[start])


def _byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed))


_TABLES = [_byte_table(s) for s in (1, 2, 3)]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive values, by doubling; nonlinear at each level."""
    out, done, power, span = None, 0, values, 1
    while True:
        if size & span:
            if out is None:
                out = power
            else:
                n = len(values) - done - span + 1
                if n <= 0:
                    return np.empty(0, _U)
                out = mix64(out[:n] * _U(0x9FB21C651E98DF25) + power[done : done + n])
            done += span
        if done == size:
            return out[: max(len(values) - size + 1, 0)]
        if len(power) <= span:
            return np.empty(0, _U)
        power = mix64(power[:-span] * _U(0xC2B2AE3D27D4EB4F) + power[span:])
        span *= 2


def least_in(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive keys."""
    span = 1
    out = keys
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values of x, sorted."""
    y = np.sort(x)
    return y[np.concatenate([[True], y[1:] != y[:-1]])] if len(y) else y


def word_hashes(data: bytes, hashes: int = 2) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Independent hashes of every word of data, and where each starts."""
    raw = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _IS_SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    return tuple(segment_hashes(_TABLES[i][raw], start, end) for i in range(hashes)), start


def _long_words(data: bytes, hashes: int) -> tuple[np.ndarray, ...]:
    found, at = [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and not _IS_SPACE[data[end]]:
            end += 1
        found.append(word_hashes(data[at:end], hashes)[0])
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Words:
    """Units are words between ASCII white space."""

    gram = 8

    @staticmethod
    def units(values: list[bytes], hashes: int = 2) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
        """(first text, unit counts of the texts, values of their units), slice by slice."""
        for i, j in slices(values, SLICE):
            if j == i + 1 and len(values[i]) > SLICE:
                found = _long_words(values[i], hashes)
                yield i, np.array([len(found[0])]), found
                continue
            part = values[i:j]
            found, start = word_hashes(b" ".join(part), hashes)
            begins = np.cumsum([0] + [len(v) + 1 for v in part])
            yield i, np.diff(np.searchsorted(start, begins)), found

    @staticmethod
    def grams(unit: tuple[np.ndarray, ...], size: int) -> np.ndarray:
        return gram_hashes(unit[0], size)

    @staticmethod
    def content(unit: tuple[np.ndarray, ...]) -> tuple[np.ndarray, int]:
        """Values whose segments tell contents apart, and how many units each value spans."""
        return unit[1], 1


class Bytes:
    """Units are the bytes of UTF-8."""

    gram = 64

    @staticmethod
    def units(values: list[bytes]) -> Iterator[tuple[int, np.ndarray, tuple[np.ndarray, ...]]]:
        for i, j in slices(values, SLICE):
            part = values[i:j]
            yield i, np.fromiter(map(len, part), np.int64, len(part)), (np.frombuffer(b"".join(part), np.uint8),)

    @staticmethod
    def grams(unit: tuple[np.ndarray, ...], size: int) -> np.ndarray:
        return gram_hashes(_TABLES[0][unit[0]], size)

    @staticmethod
    def content(unit: tuple[np.ndarray, ...]) -> tuple[np.ndarray, int]:
        return gram_hashes(_TABLES[1][unit[0]], 8), 8


def _runs(kind, unit: tuple[np.ndarray, ...], counts: np.ndarray, width: int) -> tuple[np.ndarray, ...] | None:
    n = len(unit[0])
    if n < width:
        return None
    gram = min(kind.gram, width)
    hashes = kind.grams(unit, gram)
    place = np.arange(len(hashes), dtype=_U)
    least = least_in((hashes & ~_U(0xFFFFFF)) | place, width - gram + 1)
    at = (least & _U(0xFFFFFF)).astype(np.int64)
    ends = np.cumsum(counts)
    owner_end = np.repeat(ends, counts)[: len(at)]
    valid = np.arange(len(at)) + width <= owner_end
    joined = np.zeros(len(at), bool)
    joined[1:] = valid[1:] & valid[:-1] & (at[1:] == at[:-1])
    lo = np.flatnonzero(valid & ~joined)
    if not len(lo):
        return None
    stop = np.flatnonzero(~joined)
    nxt = np.searchsorted(stop, lo, side="right")
    hi = np.where(nxt < len(stop), stop[np.minimum(nxt, len(stop) - 1)], len(at)) - 1
    content, span = kind.content(unit)
    c = segment_hashes(content, lo, hi + width - span + 1)
    c = mix64(c * _U(0x9FB21C651E98DF25) + (at[lo] - lo).astype(_U) * _U(0xD1342543DE82EF95) + (hi - lo).astype(_U))
    owner = np.searchsorted(ends, lo, side="right")
    base = (ends - counts)[owner]
    return owner, hashes[at[lo]].view(np.int64), c.view(np.int64), lo - base, hi - base, at[lo] - base


def runs(kind, values: list[bytes], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, a, c, lo, hi, at) arrays of the runs of texts."""
    for first, counts, unit in kind.units(values):
        n = len(unit[0])
        if n <= 4 * SLICE:
            found = [(0, _runs(kind, unit, counts, width))]
        else:
            # One long text: slices of window starts; a run that a slice's end cuts is two runs.
            found = [(s, _runs(kind, tuple(x[s : s + SLICE + width - 1] for x in unit), np.array([min(SLICE + width - 1, n - s)]), width)) for s in range(0, n, SLICE)]
        for base, r in found:
            if r is not None:
                owner, a, c, lo, hi, at = r
                yield owner + first, a, c, lo + base, hi + base, at + base


def window_hashes(kind, unit: tuple[np.ndarray, ...], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window of one text."""
    if kind is Words:
        return gram_hashes(unit[0], width).view(np.int64), gram_hashes(unit[1], width).view(np.int64)
    raw = unit[0]
    return gram_hashes(_TABLES[0][raw], width).view(np.int64), gram_hashes(_TABLES[2][raw], width).view(np.int64)
