"""License scans: winnowed fingerprints of templates, then banded alignment.

Texts and templates are reduced to lower-case words without punctuation. Of all runs of ``GRAM``
words, winnowing keeps the least hash of every ``WINDOW`` neighbours, in templates and texts alike, so that any shared run of
``GRAM + WINDOW - 1`` words shares a kept hash. An inverted index of the templates' kept hashes turns
a text's into anchors (a place in the text and one in a template). Anchors that follow each other on diagonals at most
``DRIFT`` words apart are one chain, so words may be missing or inserted between them. A chain's region is aligned locally with the template, in
the band of its diagonals and ``BAND`` words on either side; the share of the template's words that the alignment matches is the coverage.

A match is told if its coverage reaches the threshold, or, of a template of ``LONG`` words or more, ``PARTIAL``. Of matches that
overlap, the one with the most matched words is told alone: the notice of a license whose name holds another's, a whole text rather than its first sentence.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_bytes
from .license_texts import TEMPLATES
from .shingles import hashed_words, rolled

GRAM, WINDOW, BAND, DRIFT, COVERAGE = 3, 2, 8, 32, 0.8
#: Words of a template that may be matched in part, the share that must be, and what a skipped word on either side costs.
LONG, PARTIAL, SKIP = 40, 0.3, 0.4
#: Bytes of templates that go to every worker at most.
MOST_BYTES = 16 << 20
MATCHES = "doc_id long, license_id string, start long, end long, matched_words int, coverage double"

_PLAIN = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 0x20 for c in range(256))
_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010ffff]+")


def _winnowed(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes of runs and their places."""
    if len(h) < GRAM:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    g = rolled(h, GRAM)
    kept = np.zeros(len(g), bool)
    windows = max(1, len(g) - WINDOW + 1)
    least = np.minimum.reduce([g[i : i + windows] for i in range(min(WINDOW, len(g)))])
    for i in range(min(WINDOW, len(g))):
        kept[i : i + windows] |= g[i : i + windows] == least
    at = np.flatnonzero(kept)
    return g[at], at


def align(text: np.ndarray, template: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matched words, start, end) of the best local alignment; text place minus template place lies between ``low`` and ``high``.

    A matched word counts one, a skipped word on either side costs ``SKIP``; (0, -1, -1) without any match.
    """
    place = np.arange(len(text))
    cost = SKIP * place
    score, hits, first = np.zeros(len(text) + 1), np.zeros(len(text) + 1, np.int64), np.full(len(text) + 1, -1)  # at c: the text up to c
    best = (0.0, 0, -1, -1)
    for j, word in enumerate(template):
        inside = (place - j >= low) & (place - j <= high)
        same = inside & (text == word)
        taken = np.where(same, score[:-1] + 1, -np.inf)
        skip = score[1:] - SKIP
        use = taken > skip
        now = np.where(use, taken, skip)
        h = np.where(use, hits[:-1] + 1, hits[1:])
        f = np.where(use, np.where(hits[:-1] > 0, first[:-1], place), first[1:])
        now[~inside] = 0
        lost = now <= 0
        now[lost], h[lost], f[lost] = 0, 0, -1
        raised = now + cost  # text words are skipped: the best of all places before, less the cost of the way
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, place, 0))
        now = top - cost
        score, hits, first = (np.concatenate(([z], x)) for z, x in ((0.0, now), (0, h[source]), (-1, f[source])))
        if len(now) and same.any():
            c = int(np.argmax(np.where(same, score[1:], -1)))
            if score[c + 1] > best[0] + 1e-9:
                best = (float(score[c + 1]), int(hits[c + 1]), int(first[c + 1]), c + 1)
    return best[1:]


def chains(anchors: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(from, to, least diagonal, greatest one) of anchors (place in the text, place in the template), sorted, that follow each other."""
    out: list[list[int]] = []
    open_: dict[int, list[int]] = {}  # the last chain by diagonal, in steps of DRIFT: first place, last place and template place, diagonals, number
    for p, j in anchors:
        d = p - j
        near = [c for k in range(d // DRIFT - 1, d // DRIFT + 2) if (c := open_.get(k)) and c[1] < p <= c[1] + 4 * DRIFT and c[2] < j and abs(d - c[5]) <= DRIFT]
        if near:
            c = min(near, key=lambda c: abs(d - c[5]))
            c[1:] = p, j, min(c[3], d), max(c[4], d), d
        else:
            c = [p, p, j, d, d, d]
            out.append(c)
        open_[d // DRIFT] = c
    return [(c[0], c[1], c[3], c[4]) for c in out]


class Index:
    """Winnowed templates. Those of fewer than ``GRAM + WINDOW - 1`` words are left out."""

    def __init__(self, templates: dict[str, list[str]]):
        named = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
        words = hashed_words(text.encode().translate(_PLAIN) for _, text in named)
        self.templates = [(name, h) for (name, _), (h, _) in zip(named, words, strict=True) if len(h) >= GRAM + WINDOW - 1]
        self.words = [np.unique(h) for _, h in self.templates]
        self.places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, (_, h) in enumerate(self.templates):
            for value, at in zip(*(x.tolist() for x in _winnowed(h)), strict=True):
                self.places[value].append((t, at))
        self.keys = np.array(sorted(self.places), np.uint64)

    def find(self, h: np.ndarray, coverage: float) -> list[tuple[int, int, int, float, str]]:
        """(first word, end word, matched, coverage, license) of a text's matches, none of which overlap."""
        grams, at = _winnowed(h)
        if not len(self.keys) or not len(grams):
            return []
        k = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        hit = self.keys[k] == grams
        if not hit.any():
            return []
        anchors: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for value, place in zip(grams[hit].tolist(), at[hit].tolist(), strict=True):
            for t, j in self.places[value]:
                anchors[t].append((place, j))
        found = []
        for t, mine in anchors.items():
            name, template = self.templates[t]
            n = len(template)
            least = min(coverage, PARTIAL) if n >= LONG else coverage
            band, upto = min(BAND, n // 2), 0
            for p, q, low, high in chains(sorted(mine)):
                lo, hi = max(upto, low - band), min(len(h), high + n + band)
                if (p < lo and q < lo) or np.count_nonzero(_among(h[lo:hi], self.words[t])) < least * n:
                    continue  # within the last match, or too few of the template's words
                matched, a, b = align(h[lo:hi], template, low - band - lo, high + band - lo)
                if matched >= least * n:
                    found.append((lo + a, lo + b, matched, matched / n, name))
                    upto = lo + b  # words of a match belong to no other one of its template
        return _apart(found)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``known``, which is sorted."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _apart(found: list[tuple[int, int, int, float, str]]) -> list[tuple[int, int, int, float, str]]:
    """Matches that don't overlap: the most matched words first, then the greatest coverage, the first place and name."""
    kept: list[tuple[int, int, int, float, str]] = []
    for m in sorted(found, key=lambda m: (-m[2], -m[3], m[0], m[4])):
        i = bisect(kept, m)
        if (i == 0 or kept[i - 1][1] <= m[0]) and (i == len(kept) or kept[i][0] >= m[1]):
            kept.insert(i, m)
    return kept


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """One row per match of a template: doc_id, license_id, start, end (code points, end exclusive), matched_words, coverage.

    ``templates`` has the texts of each license id; without it those of ``license_texts`` are taken. Null and empty texts match nothing;
    texts and templates of fewer than four words match nothing. Of overlapping matches the longest is told; ties go to the greater coverage, the first place, the first
    name. A null doc_id is passed through; repeated rows are told each. No rows in, no rows out. Templates go to
    every worker: ValueError if they exceed ``MOST_BYTES`` (larger sets can be scanned in parts).
    """
    if sum(len(t.encode()) for texts in (templates or TEMPLATES).values() for t in texts) > MOST_BYTES:
        raise ValueError(f"templates of more than {MOST_BYTES} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in batches:
            raws, out = b.column("raw").to_pylist(), []
            for row, (h, _) in enumerate(hashed_words((r or b"").translate(_PLAIN) for r in raws)):
                if found := index.find(h, coverage):
                    words = [m.span() for m in _WORD.finditer(raws[row].decode())]
                    i = b.column("doc_id")[row].as_py()
                    out += [(i, name, words[a][0], words[e - 1][1], n, share) for a, e, n, share, name in found]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.float64())
            yield pa.record_batch({f.split()[0]: pa.array(c, k) for f, c, k in zip(MATCHES.split(", "), columns, kinds, strict=True)})

    return id_bytes(docs).mapInArrow(scan, MATCHES)
