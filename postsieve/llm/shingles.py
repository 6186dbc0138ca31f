"""Hashed word shingles of raw UTF-8 texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_SHORT = np.uint64(0x2545F4914F6CDD1D)
#: Bytes that are hashed at once, unless a document has more; bytes of the longest word that is hashed from the table.
CHUNK, PLACES = 1 << 17, 64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    out = h[: len(h) - size + 1] * _ODD[0]
    for i in range(1, size):
        out += h[i : len(h) - size + 1 + i] * _ODD[i]
    return mixed(out)


def shingle_set(h: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct shingles of a word sequence; fewer words than ``size`` are one shingle, none are none."""
    if len(h) >= size:
        return np.unique(rolled(h, size))
    if not len(h):
        return h
    return mixed((h * _ODD[: len(h)]).sum(dtype=np.uint64, keepdims=True) + _SHORT * np.uint64(len(h)))


#: A number for each byte at each place of a word; A-Z have those of a-z.
_TABLE = mixed(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * _ODD[1]).reshape(PLACES, 256)
_TABLE[:, 0x41:0x5B] = _TABLE[:, 0x61:0x7B]
_TABLE = _TABLE.ravel()


def hashed_words(raws: Iterable[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its words' 64-bit hashes and their lengths in bytes.

    Words are runs between blanks; A-Z count as a-z. A word's hash adds up a number for each byte at its place,
    taken for all words of many texts from one running sum; longer words than ``PLACES`` bytes are hashed one by one.
    """
    held, size = [], 0
    for raw in raws:
        held.append(raw or b"")
        size += len(held[-1]) + 1
        if size >= CHUNK:
            yield from _hashed(held)
            held, size = [], 0
    if held:
        yield from _hashed(held)


def _hashed(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    turns = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[raw]))))  # the last byte is a blank: turns come in pairs
    starts, ends = turns[::2], turns[1::2]
    sizes = ends - starts
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])).tolist()
    first = int(starts[0]) if len(starts) else len(raw)
    place = np.arange(first, len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    np.minimum(place, PLACES - 1, out=place)
    sums = np.zeros(len(raw) - first + 1, np.uint64)
    np.cumsum(_TABLE[place << 8 | raw[first:]], out=sums[1:])
    hashes = mixed(sums[ends - first] - sums[starts - first] + sizes.astype(np.uint64) * _ODD[2])
    for i in np.flatnonzero(sizes > PLACES).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes().lower())
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield hashes[a:b], sizes[a:b]
