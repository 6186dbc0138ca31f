"""Entity spans from lexicons, and their merge."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsieve.session import ship

# Confidences of sources and their order, the best first.
CONFIDENCE = {"regex": 0.95, "lexicon": 0.85, "ner": 0.75}
PRIORITY = ("regex", "lexicon", "ner")

#: Characters of a lexicon that may be broadcast.
SMALL = 8 << 20

ENTITY = "struct<start:int,end:int,text:string,label:string,source:string,confidence:double>"
_COLUMNS = "doc_id long, start int, end int, text string, label string, source string, confidence double"


def by_regex(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Matches of a label's patterns in its texts.

    ``texts``: doc_id, label_id, text. ``lexicon``: label_id, lemma, regex_pattern. Patterns are grouped
    by label and stand beside each text; they run in Python, whose syntax they are written in, compiled
    once per worker. Invalid and missing ones match nothing. Matching ignores case.
    """
    ship(texts.sparkSession)
    entries = lexicon.filter("lemma is not null and regex_pattern is not null").groupBy("label_id").agg(F.array_sort(F.collect_set(F.struct("lemma", "regex_pattern"))).alias("entries"))
    joined = _beside(texts, entries, "lemma", "regex_pattern", lexicon).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "entries")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, text, known in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                for e in known:
                    if pattern := _compiled(e["regex_pattern"]):
                        rows += [(i, m.start(), m.end(), m.group(0), e["lemma"], "regex", CONFIDENCE["regex"]) for m in pattern.finditer(text)]
            yield _batch(rows)

    return joined.mapInArrow(match, _COLUMNS)


_patterns: dict[str, re.Pattern | None] = {}


def _compiled(pattern: str) -> re.Pattern | None:
    if pattern not in _patterns:
        if len(_patterns) > 10_000:
            _patterns.clear()
        try:
            _patterns[pattern] = re.compile(pattern, re.IGNORECASE)
        except (re.error, OverflowError):
            _patterns[pattern] = None
    return _patterns[pattern]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64())
    return pa.record_batch({f.split()[0]: pa.array(c, k) for f, c, k in zip(_COLUMNS.split(", "), columns, kinds, strict=True)})


def _beside(texts: DataFrame, entries: DataFrame, lemma: str, forms: str, lexicon: DataFrame) -> DataFrame:
    """Texts with their label's entries. A lexicon of up to ``SMALL`` characters is broadcast, so texts stay where they are, however few labels there are; a larger one is joined by a shuffle."""
    size = lexicon.agg(F.coalesce(F.sum(F.length(lemma) + F.length(F.col(forms).cast("string"))), F.lit(0))).first()[0]
    return texts.join(F.broadcast(entries) if size <= SMALL else entries, "label_id")


def by_lexicon(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Whole-word hits of a label's surface forms (label_id, lemma, surface_forms), any case; one row per span and lemma of each text.

    Native: a form is looked up at the places where a word starts. Forms are gone through within a text's row; only its hits leave it.
    """
    forms = lexicon.filter("lemma is not null").select("label_id", "lemma", F.explode("surface_forms").alias("form")).filter("form <> ''")
    grouped = forms.groupBy("label_id").agg(F.array_sort(F.collect_set(F.struct("lemma", F.lower("form").alias("form")))).alias("forms"))
    rows = _beside(texts, grouped, "lemma", "surface_forms", lexicon).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "forms").withColumn("low", F.lower("text"))
    low, alone = F.col("low"), lambda c: ~F.coalesce(c.rlike(r"[\p{L}\p{N}]"), F.lit(False))

    def hits(f: Column) -> Column:
        n = F.length(f["form"])
        whole = lambda p: alone(F.when(p > 1, F.substring(low, p - 1, F.lit(1)))) & alone(F.substring(low, p + n, F.lit(1)))
        found = F.filter(_places(low, f["form"]), whole)
        return F.transform(found, lambda p: F.struct((p - 1).alias("start"), (p - 1 + n).alias("end"), F.substring(F.col("text"), p, n).alias("text"), f["lemma"].alias("label")))

    every = F.array_distinct(F.flatten(F.transform(F.filter("forms", lambda f: F.contains(low, f["form"])), hits)))
    told = rows.select("doc_id", F.explode_outer(every).alias("h")).filter("h is not null")  # an inner explode would run all twice, for the filter on its size
    return told.select("doc_id", "h.*", F.lit("lexicon").alias("source"), F.lit(CONFIDENCE["lexicon"]).alias("confidence"))


def _places(low: Column, form: Column) -> Column:
    """All places (from 1) at which a text has another one as whole words, overlapping ones too; also 1 if it starts with it."""
    literal = F.concat(F.lit(r"(?=\Q"), F.replace(form, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![\p{L}\p{N}]))(?<![\p{L}\p{N}])"))
    gaps = F.transform(F.split(low, literal, -1), F.length)
    ends = F.aggregate(gaps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, g: F.struct((a["at"] + g).alias("at"), F.concat(a["out"], F.array(a["at"] + g)).alias("out")))["out"]
    starts = F.transform(F.concat(F.array(F.lit(0)), ends), lambda x: x + 1)
    return F.filter(F.array_distinct(starts), lambda p: F.substring(low, p, F.length(form)) == form)


def merged(entities: DataFrame) -> DataFrame:
    """doc_id and its entities without overlaps, by start.

    Candidates are taken by start, the longer, the better source, the higher confidence first. One that
    overlaps the last kept (no other can overlap: kept ones are disjoint) takes its place if its source
    is better, or equal and it is longer, or as long and surer; else it goes.
    """
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("source")).cast("int")
    item = F.struct("start", (-F.col("end")).alias("minus_end"), rank.alias("rank"), (-F.col("confidence")).alias("minus_conf"), "label", "text", "source", "confidence", "end")
    rows = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = "array<struct<start:int,minus_end:int,rank:int,minus_conf:double,label:string,text:string,source:string,confidence:double,end:int>>"

    def step(kept: Column, e: Column) -> Column:
        last = F.element_at(kept, -1)
        overlap = (F.size(kept) > 0) & ~((e["end"] <= last["start"]) | (last["end"] <= e["start"]))
        longer = (e["end"] - e["start"]) - (last["end"] - last["start"])
        better = (e["rank"] < last["rank"]) | ((e["rank"] == last["rank"]) & ((longer > 0) | ((longer == 0) & (e["confidence"] > last["confidence"]))))
        swapped = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(e))
        return F.when(F.size(kept) == 0, F.array(e)).when(~overlap, F.concat(kept, F.array(e))).when(better, swapped).otherwise(kept).cast(kind)

    folded = rows.withColumn("kept", F.aggregate("all", F.array().cast(kind), step))
    return folded.select("doc_id", F.expr("transform(array_sort(kept), x -> named_struct('start', x.start, 'end', x.end, 'text', x.text, 'label', x.label, 'source', x.source, 'confidence', x.confidence))").alias("entities"))


def extract(texts: DataFrame, regex_lexicon: DataFrame, ner_lexicon: DataFrame, recogniser=None) -> DataFrame:
    """Regex, recogniser and gazetteer entities, merged. ``recogniser`` maps texts to rows like theirs; offline there is none."""
    found = by_regex(texts, regex_lexicon).unionByName(by_lexicon(texts, ner_lexicon))
    if recogniser is not None:
        found = found.unionByName(recogniser(texts))
    return merged(found)
