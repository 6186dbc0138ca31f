"""Keyword candidates: counted n-grams, filtered and scored.

A document is one row, so its n-grams are counted, and without a scorer also ranked, in its own row. Words are cut natively.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postsieve.functions import terms
from postsieve.session import ship
from postsieve.settings import DEFAULT, Settings


COUNTED = "source string, term string, count int, ngram_size int"
#: Rows of a batch that a task returns, more or less.
BATCH = 1 << 16


def _cut(docs: DataFrame, *keep: str) -> DataFrame:
    """The words of subject and body, and columns that stay."""
    ship(docs.sparkSession)
    words = lambda c: terms.tokens(F.coalesce(F.col(c), F.lit(""))).alias(c)
    return docs.select("doc_id", *keep, words("subject"), words("body"))


def _counted(words: list[str], most: int, least: int) -> Iterator[tuple[str, int, int]]:
    """(term, count, words in it) of all runs of up to ``most`` words; a run's words hold no blank, so sizes don't mix."""
    for n in range(1, most + 1):
        runs = words if n == 1 else map(" ".join, zip(*(words[i:] for i in range(n)), strict=False))
        for term, count in Counter(runs).items():
            if len(term) >= least:
                yield term, count, n


def _rows(cut: DataFrame, schema: str, of, given: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``of`` makes of each row's subject words, body words and ``given`` columns, after the row's other columns. Texts are read where they lie: nothing is shuffled."""
    names = [c for c in cut.columns if c not in ("subject", "body", *given)]
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    fields = [(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))]

    def batch(held: list[tuple], rows: list[int], b: pa.RecordBatch) -> pa.RecordBatch:
        kept = b.select(names).take(pa.array(rows, pa.int64()))
        columns = list(zip(*held, strict=True)) if held else [()] * len(fields)
        return pa.record_batch([*kept.columns, *(pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True))], names=[*names, *(n for n, _ in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, rows = [], []
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("subject", "body", *given)), strict=True)):
                made = of(*row)
                held += made
                rows += [i] * len(made)
                if len(held) >= BATCH:
                    yield batch(held, rows, b)
                    held, rows = [], []
            yield batch(held, rows, b)

    return cut.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in cut.dtypes if n in names) + f", {schema}")


def build(docs: DataFrame, s: Settings = DEFAULT, lemmas: DataFrame | None = None) -> DataFrame:
    """doc_id, candidate_id, source, term, count, lemma, ngram_size of ``docs`` (doc_id, subject, body), one row of which is one document.

    ``lemmas`` (form, lemma) is joined word by word; without it a term is its own lemma, in lower case.
    """
    most, least = s.max_ngram, s.min_term_length
    of = lambda subject, body: [(source, *row) for source, words in (("subject", subject), ("body", body)) for row in _counted(words, most, least)]
    counted = _rows(_cut(docs), COUNTED, of)
    made = counted.withColumn("candidate_id", terms.stable_id(F.col("source"), F.col("term"))).withColumn("lemma", F.lower("term"))
    return _lemmatised(made, lemmas) if lemmas is not None else made


def _id(source: str, term: str) -> str:
    """As ``terms.stable_id``."""
    return hashlib.sha1(f"{source}|{term}".encode()).hexdigest()[:12]


Embedded = Callable[[list[str]], list[tuple[str, float]]]


def best(
    docs: DataFrame, most: int | None = None, s: Settings = DEFAULT, stop_words: tuple[str, ...] = terms.STOP_WORDS, keep: tuple[str, ...] = (),
    embedded: Embedded | None = None, positive: bool = False, only: Callable[[str, int, int], bool] | None = None, ids: str | None = None,
) -> DataFrame:
    """The ``most`` best candidates of each document (all without it), filtered, scored and ranked where its text lies: no shuffle.

    ``embedded`` gives the embedding scores of the terms of a row's words (of subject, then body); others have 0. With ``positive``
    only candidates with a score above 0 are returned, with ``only`` those for which it holds (of term, size, rank), with
    ``ids`` those whose candidate_id is in the array of that name (null: none); ranks are those among all.
    Columns as those of ``ranked``, and ``keep``.
    """
    stop, bad = frozenset(stop_words), re.compile("|".join(f"(?:{p})" for p in terms.BLACKLIST), re.IGNORECASE | re.ASCII)
    (a, e, c), n, least = (s.weight_count, s.weight_embedding, s.weight_subject), s.max_ngram, s.min_term_length

    def of(subject: list[str], body: list[str], named: list[str] | None = None) -> list[tuple]:
        if ids and not named:
            return []
        wanted = frozenset(named or ())
        scores = dict(embedded(subject + body)) if embedded else {}
        found, others = [], Counter()
        apart = positive and all(abs(e * x) > 1e-9 for x in scores.values() if x)
        for source, words, extra in (("subject", subject, c), ("body", body, 0.0)):
            for term, count, size in _counted(words, n, least):
                if term not in stop and (term[0] > "9" or not bad.search(term)):  # no blacklisted term of words begins with a letter
                    near = scores.get(term, 0.0)
                    if apart and not near:
                        others[source == "body", count] += 1
                        continue
                    score = a * math.log1p(count) / 5.0 + e * near + extra
                    found.append((-round(score, 12), source == "body", -count, term, size, score, near))
        order = sorted(found) if most is None else heapq.nsmallest(most, found)
        ranks = range(1, len(order) + 1)
        if others:  # their keys depend on source and count alone, and are set apart from those of candidates with a score
            keys = sorted((-round(a * math.log1p(count) / 5.0 + (0.0 if body_ else c), 12), body_, -count, many) for (body_, count), many in others.items())
            before = [0, *accumulate(k[3] for k in keys)]
            firsts = [k[:3] for k in keys]
            ranks = [rank + before[bisect_left(firsts, x[:3])] for rank, x in enumerate(order, 1)]
        rows = (("body" if body_ else "subject", term, -count, size, near, score, rank) for rank, (_, body_, count, term, size, score, near) in zip(ranks, order, strict=True))
        return [r for r in rows if (not positive or r[4] > 0) and (most is None or r[6] <= most) and (only is None or only(r[1], r[3], r[6])) and (not ids or _id(r[0], r[1]) in wanted)]

    given = (ids,) if ids else ()
    made = _rows(_cut(docs, *keep, *given), f"{COUNTED}, embedding_score double, composite_score double, rank int", of, given)
    return made.withColumns({"candidate_id": terms.stable_id(F.col("source"), F.col("term")), "lemma": F.lower("term")})


def _lemmatised(made: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Each distinct term is lemmatised once."""
    words = made.select("term").distinct().select("term", F.posexplode(F.split("term", " ")).alias("i", "form"))
    joined = words.join(lemmas.dropDuplicates(["form"]), "form", "left")
    whole = joined.groupBy("term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("lemma", "form").alias("w")))), lambda x: x["w"]), " ").alias("lemma"))
    return made.drop("lemma").join(whole, "term")


def filtered(made: DataFrame, stop_words: tuple[str, ...] = terms.STOP_WORDS, least: int = 3) -> DataFrame:
    """Without stop words (whole term or lemma), blacklisted terms and short terms."""
    low, lemma = F.lower("term"), F.lower("lemma")
    return made.filter(~low.isin(*stop_words) & ~lemma.isin(*stop_words) & ~terms.blacklisted(low) & (F.length("term") >= least))


Scorer = Callable[[DataFrame], DataFrame]


def scored(kept: DataFrame, docs: DataFrame | None = None, scorer: Scorer | None = None, s: Settings = DEFAULT) -> DataFrame:
    """Adds embedding_score and composite_score.

    ``scorer`` maps ``docs`` to (doc_id, keyword, score); a candidate takes the score of its term, else
    of its lemma, else 0. Without one all embedding scores are 0.
    """
    if scorer is None:
        out = kept.withColumn("embedding_score", F.lit(0.0))
    else:
        scores = scorer(docs).select(F.col("doc_id"), F.col("keyword"), F.col("score"))
        by_term = scores.toDF("doc_id", "term", "by_term")
        by_lemma = scores.toDF("doc_id", "lemma", "by_lemma")
        out = kept.join(by_term, ["doc_id", "term"], "left").join(by_lemma, ["doc_id", "lemma"], "left")
        out = out.withColumn("embedding_score", F.coalesce("by_term", "by_lemma", F.lit(0.0))).drop("by_term", "by_lemma")
    weights = (s.weight_count, s.weight_embedding, s.weight_subject)
    return out.withColumn("composite_score", terms.composite_score(F.col("count"), F.col("embedding_score"), F.col("source") == "subject", weights))


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank`` in a document: by score, then subject first, count, term."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(F.round("composite_score", 12)), F.desc("source"), F.desc("count"), "term")
    return rows.withColumn("rank", F.row_number().over(order))


def extract(docs: DataFrame, s: Settings = DEFAULT, scorer: Scorer | None = None) -> DataFrame:
    """All candidates of each document, filtered, scored and ranked. A scorer with ``of_words`` (``relevance.scorer``) is asked in the document's own row; others are joined."""
    of_words = getattr(scorer, "of_words", None)
    return best(docs, s=s, embedded=of_words) if scorer is None or of_words else ranked(scored(filtered(build(docs, s), least=s.min_term_length), docs, scorer, s))


def stats(docs: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Per document: tokens of subject and body, candidates before and after the filter."""
    raw = build(docs, s)
    flagged = raw.withColumn("kept", ~F.lower("term").isin(*terms.STOP_WORDS) & ~terms.blacklisted(F.lower("term")))
    counts = flagged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_raw"), F.count_if("kept").alias("n_filtered"))
    sizes = docs.select("doc_id", *(F.size(terms.tokens(F.coalesce(c, F.lit("")))).cast("long").alias(f"n_{c}_tokens") for c in ("subject", "body")))
    return sizes.join(counts, "doc_id", "left").fillna(0, ["n_raw", "n_filtered"])


def prompt_candidates(rows: DataFrame, most: int = 100) -> DataFrame:
    """doc_id and a JSON array of its best candidates, scores rounded to three places, in order of rank."""
    top = ranked(rows).filter(F.col("rank") <= most)
    item = F.struct("rank", F.struct("candidate_id", "term", "lemma", "count", "source", F.round("composite_score", 3).alias("score")).alias("c"))
    return top.groupBy("doc_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["c"])).alias("candidates_json"), F.count(F.lit(1)).alias("n"))
