"""Language identification by rank-order profiles.

A profile lists a language's most frequent 1- to 3-grams of letters in order; words are padded
with blanks. A document's own most frequent n-grams are ranked likewise and the out-of-place
distance to each profile is the mean of how far each n-gram stands from its place there (at most
the profile's size). The nearest profile wins.

Profiles are fitted on ``per_language`` labelled documents of each language, chosen by a
hash of the id and the text, and for the ``languages`` most frequent ones. Prediction reads whole texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, listed

PROFILE = 400
PER_LANGUAGE = 500
UNKNOWN = "und"
#: Languages that are learned at most: the most frequent ones.
LANGUAGES = 1000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point itself if it is a letter, else 0 (the blank)."""
    table = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 1- to 3-grams of a text as integers (21 bits a letter), and their counts."""
    codes = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = np.concatenate(([0], codes, [0]))
    c = c[(c != 0) | np.concatenate(([True], c[:-1] != 0))]  # one blank between words
    a, b, d = c[:-2], c[1:-1], c[2:]
    two = c[:-1] << 21 | c[1:]
    three = (a << 42 | b << 21 | d)[b != 0]
    return np.unique(np.concatenate((c[c != 0], two, three)), return_counts=True)


def ranked(values: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """The n most frequent, ties by value."""
    order = np.lexsort((values, -counts))[:n]
    return values[order]


def fit_profiles(docs: DataFrame, lang: str = "lang", learn: Column | None = None, per_language: int = PER_LANGUAGE, size: int = PROFILE, languages: int = LANGUAGES) -> dict[str, list[int]]:
    """Profiles of the ``languages`` most frequent languages; the driver receives ``size`` integers of each.

    Learns from rows where ``learn`` holds and lang and text are not null. Equal counts rank by the language's name, or the
    n-gram's code, so equal inputs give equal profiles. Rows that repeat id and text are chosen together. Without such rows there are no profiles.
    """
    rows = docs.filter(F.coalesce(learn, F.lit(False))) if learn is not None else docs
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter("lang is not null and text is not null")
    hashed = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(languages).collect()}
    if not counts:
        return {}
    # The least hashes of each language: a share of its rows that holds enough of them but for a negligible chance, then the least of these.
    likely = [(name, min((1 << 63) - 1, int((1 << 63) * (per_language + 8 * per_language**0.5 + 32) / n))) for name, n in counts.items()]
    few = hashed.select("lang", "h").join(F.broadcast(listed(rows.sparkSession, likely, "lang string, most long")), "lang").filter("h <= most")
    ranks = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    cut = few.withColumn("k", ranks).filter(F.col("k") <= per_language).groupBy("lang").agg(F.max("h").alias("cut")).collect()
    cuts = F.broadcast(listed(rows.sparkSession, [(r.lang, r.cut) for r in cut], "lang string, cut long"))
    sample = hashed.join(cuts, "lang").filter("h <= cut")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list] = defaultdict(list)
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[name].append(grams(text))
        for name, got in seen.items():
            values, at = np.unique(np.concatenate([v for v, _ in got]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([c for _, c in got]), minlength=len(values)).astype(np.int64)
            yield pa.record_batch({"lang": pa.array([name] * len(values), pa.string()), "gram": pa.array(values, pa.int64()), "n": pa.array(n)})

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= size).select("lang", "gram", "k")
    out: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for r in top.collect():
        out[r.lang].append((r.k, r.gram))
    return {name: [g for _, g in sorted(out[name])] for name in sorted(out)}


class Matcher:
    """Out-of-place distances to all profiles at once: a sorted table of n-grams with their rank in each profile."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.size, self.names = size, list(profiles)
        self.grams = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for i, p in enumerate(profiles.values()):
            self.ranks[i, np.searchsorted(self.grams, np.array(p, np.int64))] = np.arange(len(p))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language and a score: 1 for an equal ranking, 0 if nothing of it is in the profile."""
        if not text or not self.names:
            return UNKNOWN, 0.0
        values, counts = grams(text)
        if not len(values):
            return UNKNOWN, 0.0
        own = ranked(values, counts, self.size)
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[:, at]
        off = np.where(ranks < 0, self.size, np.minimum(np.abs(ranks - np.arange(len(own))), self.size)).sum(axis=1)
        best = int(np.argmin(off))
        return self.names[best], float(1 - off[best] / (self.size * len(own)))


def identify_language(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (0 to 1).

    ``und`` with score 0 if the text is null or has no letter, or if there are no profiles. Ties go to
    the language that sorts first. A null doc_id is passed through; repeated rows give equal rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, size)
        for b in batches:
            got = [matcher.predict(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "lang_pred": pa.array([x for x, _ in got], pa.string()), "score": pa.array([x for _, x in got], pa.float64())})

    return id_text(docs).mapInArrow(predict, "doc_id long, lang_pred string, score double")
