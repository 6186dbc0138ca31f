"""Token counts and token ids by a two-tier table of pre-tokens.

A byte-pair tokenizer treats each pre-token on its own, so a text's ids are those of its pre-tokens
in order. Texts are cut by the tokenizer's own rule, as a regular expression over the whole text,
whatever they hold. The table's first tier has the lengths of frequent pre-tokens; it is learned from a bounded
sample and broadcast. The second is the worker's cache: what the first lacks is encoded by the
library when a worker first meets it and held up to a bounded number. Both are keyed by the
pre-token itself, not by a hash, so results are the library's. No pre-token of the corpus is shuffled.

Only texts with one of the tokenizer's special strings, or with a code point that Unicode hasn't
assigned, go to the library whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

#: Documents that the table of frequent pre-tokens is learned from, and its entries. They alter speed alone.
SAMPLE_DOCS = 1000
TABLE_SIZE = 50_000
#: Pre-tokens that a worker's cache holds at most (it starts anew beyond that), the characters of the longest, characters cut at once.
CACHED, CACHED_CHARS, AT_ONCE = 600_000, 48, 1 << 19
#: As CACHED, for pre-tokens with their ids, which take twice the memory of lengths: some 70 MB of a worker.
CACHED_IDS = 300_000

#: White space as the tokenizers know it, and the letters and numbers below U+0180.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER, _NUMBER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: A character whose class or lower case the short classes don't tell: beyond U+017F, but for punctuation and currency signs.
_BEYOND = re.compile("[^\0-\u017f\u2010-\u2027\u2030-\u203e\u20a0-\u20bf]")
#: Where a text may be cut without parting a pre-token: before white space.
_SEAM = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")


def _patterns(rule: str) -> tuple:
    """The rule with L, N and S as classes: for texts of known characters, and for all."""
    short = re.compile(rule.replace("L", _LETTER).replace("N", _NUMBER).replace("S", _SPACE))
    return short, regex.compile(rule.replace("L", r"\p{L}").replace("N", r"\p{N}").replace("S", _SPACE))


#: How the two kinds of tokenizer cut texts.
_BYTES = _patterns(" ?[L]+| ?[N]+|'(?:[stmd]|re|ve|ll)| ?[^SLN]+|[S]+(?![^S])|[S]+")
_WORDS = _patterns("[L]+|[N]|'(?:[stmd]|re|ve|ll)|[^SLN]+")


@lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Code points without a meaning yet, which libraries of other years may class otherwise."""
    none = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    turns = np.flatnonzero(np.diff(np.concatenate(([False], none, [False])))).reshape(-1, 2).tolist()
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in turns) + "]")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return [chr(b if b in printable else 256 + others.index(b)) for b in range(256)]


_LETTERS = _byte_letters()


class Encoder:
    """A tokenizer file with a cache. ``word`` is set for a file that lower-cases and drops blanks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.word = bool(spec.get("normalizer"))
        self.special = [x["content"] for x in spec.get("added_tokens") or []]
        self.table: dict[str, int] = {}
        self.lengths: dict[str, int] = {}
        self.ids: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str] | None:
        """The pre-tokens of a text in order; None if it must go to the library whole: for a special string or an unassigned code point."""
        beyond = _BEYOND.search(text) is not None
        if any(s in text for s in self.special) or (beyond and _unassigned().search(text)):
            return None
        if self.word:
            text = self.tokenizer.normalizer.normalize_str(text) if beyond else text.lower()
        return (_WORDS if self.word else _BYTES)[beyond].findall(text)

    def encoded(self, piece: str) -> bytes | None:
        """The ids of a pre-token; None for one that the normalizer alters once more."""
        if self.word and not piece.isascii() and self.tokenizer.normalizer.normalize_str(piece) != piece:
            return None
        return array("I", [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))]).tobytes()

    def _found(self, text: str, cache: dict, value) -> list | None:
        """The values of a text's pre-tokens in order; None if it must go to the library whole."""
        pieces = self.pieces(text)
        if pieces is None:
            return None
        found = list(map(cache.get, pieces))
        if None not in found:
            return found
        if len(cache) > (CACHED if cache is self.lengths else min(CACHED, CACHED_IDS)):
            cache.clear()
            cache.update(self.table if cache is self.lengths else {})
        long = {}
        for i in compress(range(len(found)), [x is None for x in found]):
            piece = pieces[i]
            kept = cache if len(piece) <= CACHED_CHARS else long
            if (known := kept.get(piece)) is None:
                ids = self.encoded(piece)
                if ids is None:
                    return None
                known = kept[piece] = value(ids)
            found[i] = known
        return found

    def _parts(self, text: str, cache: dict, value) -> list[list] | None:
        """The values of a text, cut at seams into parts of bounded size; None if it must go to the library whole."""
        if any(s in text for s in self.special):
            return None
        out = []
        for part in seamed(text):
            if (found := self._found(part, cache, value)) is None:
                return None
            out.append(found)
        return out

    def count(self, text: str) -> int:
        """The number of a text's tokens."""
        if not self.lengths:
            self.lengths.update(self.table)
        parts = self._parts(text, self.lengths, lambda ids: len(ids) // 4)
        return len(self.whole(text)) // 4 if parts is None else sum(map(sum, parts))

    def text_ids(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        parts = self._parts(text, self.ids, bytes)
        return self.whole(text) if parts is None else b"".join(map(b"".join, parts))


def seamed(text: str) -> Iterator[str]:
    """The text in parts of about ``AT_ONCE`` characters, parted before white space (at the end of a longer word, if there is one)."""
    at = 0
    while len(text) - at > AT_ONCE and (seam := _SEAM.search(text, at + AT_ONCE)):
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:] if at else text


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; it outlives the tasks of a reused Python worker."""
    return Encoder(path)


def frequent_lengths(docs: DataFrame, path: str, sample: int = SAMPLE_DOCS, entries: int = TABLE_SIZE) -> dict[str, int]:
    """Token lengths of the most frequent pre-tokens of at most ``sample`` documents, taken by a hash of the id.

    The driver receives ``sample`` ids and ``entries`` pre-tokens of ``CACHED_CHARS`` characters at most.
    """
    chosen = id_text(docs).select("doc_id").filter("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = [r[0] for r in chosen.collect()]
    if not ids:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            seen: Counter[str] = Counter()
            for t in b.column(0).to_pylist():
                for part in seamed(t or ""):
                    seen.update(enc.pieces(part) or ())
            short = [p for p in seen if len(p) <= CACHED_CHARS]
            if short:
                coded = [(p, len(x) // 4) for p in short if (x := enc.encoded(p)) is not None]
                yield pa.record_batch({"piece": pa.array([p for p, _ in coded], pa.string()), "tokens": pa.array([k for _, k in coded], pa.int64()), "n": pa.array([seen[p] for p, _ in coded], pa.int64())})

    texts = id_text(docs).filter(F.col("doc_id").isin(ids)).select("text")
    top = texts.mapInArrow(count, "piece string, tokens long, n long").groupBy("piece").agg(F.sum("n").alias("n"), F.max("tokens").alias("tokens")).orderBy(F.desc("n"), "piece").limit(entries)
    return {r.piece: r.tokens for r in top.collect()}


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty (0 bytes, 0 tokens); a null doc_id is passed through; repeated rows
    are counted each. No rows in, no rows out.
    """
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        enc.table = frequent.value
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": pa.array(map(enc.count, texts), pa.int64()), "n_bytes": pa.array([_bytes(t) for t in texts], pa.int64())})

    counted = id_text(docs).mapInArrow(count, "doc_id long, n_tokens long, n_bytes long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())
