import json
import math
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsieve.functions import signals
from postsieve.operators import candidates, classify, dictionary, entities, evaluate
from postsieve.settings import Settings
from postsieve.sources import lists


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# Candidates


def test_candidates(spark):
    docs = frame(spark, [(1, "Problema fattura", "La fattura ha un problema. Fattura!"), (2, None, None), (3, "", "a b")], "doc_id long, subject string, body string")
    rows = {(r.doc_id, r.source, r.term): r for r in candidates.build(docs).collect()}
    assert rows[1, "body", "fattura"]["count"] == 2 and rows[1, "subject", "problema fattura"].ngram_size == 2
    assert not any(k[0] == 2 for k in rows) and (3, "body", "a b") in rows
    kept = {(r.source, r.term) for r in candidates.filtered(candidates.build(docs)).filter("doc_id = 1").collect()}
    assert ("body", "la") not in kept and ("body", "la fattura") in kept
    best = candidates.extract(docs).filter("doc_id = 1 and rank = 1").first()
    assert best.source == "subject" and best.composite_score == pytest.approx(0.3 * math.log(2) / 5 + 0.2)


def test_scorer_and_lemmas(spark):
    docs = frame(spark, [(1, "", "clienti e fatture")], "doc_id long, subject string, body string")
    lemmas = frame(spark, [("clienti", "cliente"), ("fatture", "fattura")], "form string, lemma string")
    made = candidates.build(docs, lemmas=lemmas)
    assert {r.term: r.lemma for r in made.collect()}["clienti e fatture"] == "cliente e fattura"
    scorer = lambda d: d.select("doc_id", F.lit("cliente").alias("keyword"), F.lit(0.8).alias("score"))
    scores = {r.term: r.embedding_score for r in candidates.scored(made, docs, scorer).collect()}
    assert scores["clienti"] == 0.8 and scores["fatture"] == 0.0


def test_candidates_need_no_exchange(spark):
    docs = frame(spark, [(1, "a", "b")], "doc_id long, subject string, body string")
    for made in (candidates.extract(docs), candidates.best(docs, 3), candidates.build(docs)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_best_equals_ranked_candidates(spark):
    words = ["la", "fattura", "problema", "123", "re", "cliente", "urgente", "è", "già", "l'ordine", "Fattura"]
    rng = random.Random(2)
    docs = frame(spark, [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(6))), " ".join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(40)] + [(99, None, None)], "doc_id long, subject string, body string")
    want = candidates.ranked(candidates.scored(candidates.filtered(candidates.build(docs))))
    cols = ["doc_id", "rank", "source", "term", "count", "ngram_size", "candidate_id", "lemma"]
    read = lambda df: sorted((*(r[c] for c in cols), round(r.composite_score, 9)) for r in df.collect())
    assert read(candidates.extract(docs)) == read(want) and read(candidates.best(docs, 4)) == read(want.filter("rank <= 4"))


# Status and priority


def test_crm(spark):
    docs = frame(spark, [(0, "MARIO.rossi@example.com "), (1, "x@cliente.it"), (2, "Anna <anna@company.com>"), (3, None), (4, ""), (5, "broken")], "i int, from_address string")
    got = {r.i: r.crm_match for r in classify.known_senders(docs, lists.known_emails(spark), lists.known_domains(spark)).collect()}
    assert got == {0: "exact", 1: "domain", 2: "domain", 3: "none", 4: "none", 5: "none"}


def test_text_signal(column):
    got = column(signals.text_signal, "sono un vostro cliente dal 2020", "questo è il primo contatto", "ho già un contratto", "ho GIÀ un CONTRATTO", "", "vostro cliente, primo contatto")
    assert got == ["existing", "new", "existing", "existing", None, None]


def test_deadlines(column):
    texts = ["entro oggi", "entro 5 giorni", "scadenza: 2024-01-02", "la scadenza", "entro il 3/4", "al più presto", "nulla", "entro fine, questa settimana"]
    assert column(signals.deadline_boost, *texts) == [3, 2, 2, 1, 2, 3, 0, 2]
    assert column(signals.deadline_patterns, "scadenza e tempo limitato")[0] == [r"(?i)\bscadenza\b"]


@pytest.mark.parametrize(
    "subject, body, sentiment, status, vip, value, score",
    [
        ("Urgente", "problema bloccante entro oggi", "negative", "new", False, "urgent", 3 + 3 + 1.5 + 2 + 1 + 6), ("Info", "richiesta", "positive", "unknown", False, "low", 0), ("x", "guasto importante", "neutral", "existing", False, "medium", 3.0),
        ("x", "errore", "neutral", "existing", True, "high", 4.0), (None, None, None, None, None, "low", 0), ("urgenza", "", "neutral", "existing", False, "high", 4.5),
    ],
)
def test_priority(spark, subject, body, sentiment, status, vip, value, score):
    row = signals.priority(frame(spark, [(subject, body, sentiment, status, vip)], "s string, b string, x string, c string, v boolean"), *(F.col(c) for c in "sbxcv")).first().priority
    assert (row.value, row.raw_score) == (value, score)


# Model output


def output(**change):
    topic = {"label_id": "RECLAMO", "confidence": 0.8, "keywords_in_text": [{"candidate_id": "c1", "lemma": "l", "count": 1}], "evidence": [{"quote": "q"}]}
    out = {"dictionary_version": 1, "topics": [topic], "sentiment": {"value": "neutral", "confidence": 0.5}, "priority": {"value": "low", "confidence": 0.5}, "customer_status": {"value": "new", "confidence": 0.5, "source": "llm_guess"}}
    return out | change


def validated(spark, *outputs):
    rows = frame(spark, [(i, x if isinstance(x, str | None) else json.dumps(x)) for i, x in enumerate(outputs)], "doc_id long, json string")
    offered = frame(spark, [(i, c) for i in range(len(outputs)) for c in ("c1", "c2")], "doc_id long, candidate_id string")
    return classify.validate(rows, offered).orderBy("doc_id")


def topic(**change):
    return output()["topics"][0] | change


def test_validation(spark):
    cases = [
        (output(), [], False), ("{broken", ["Invalid JSON"], False), (None, ["Invalid JSON"], False), ({k: v for k, v in output().items() if k != "sentiment"}, ["Schema violation at sentiment"], False),
        (output(topics=[topic(confidence=1.5)]), ["Schema violation at topics.0.confidence"], False), (output(topics=[topic(confidence="alta")]), ["Schema violation at topics.0.confidence"], False),
        (output(topics=[topic(label_id="ALTRO")]), ["Schema violation at topics.0.label_id"], False), (output(topics=[topic(evidence=[])]), ["Schema violation at topics.0.evidence"], False),
        (output(topics=[topic(keywords_in_text=[{"candidate_id": "zz", "lemma": "l", "count": 1}])]), ["Invalid candidate_id in topic 0, keyword 0: zz"], True), (output(sentiment={"value": "angry", "confidence": 0.1}), ["Schema violation at sentiment.value"], False),
        (output(topics=[topic(keywords_in_text=[{"candidate_id": "c1", "lemma": "l", "count": 0}])]), ["Schema violation at topics.0.keywords_in_text.0.count"], False), (output(topics=[]), [], False),
        (output(customer_status={"value": "new", "confidence": 0.5}), ["Schema violation at customer_status.source"], False),
    ]
    for row, (_, errors, retry) in zip(validated(spark, *(c[0] for c in cases)).collect(), cases, strict=True):
        assert (row.errors, row.should_retry, row.valid) == (errors, retry, not errors)
        assert (row.topics is None) == bool(errors)


def test_duplicates(spark):
    kws = [{"candidate_id": c, "lemma": c, "count": 1} for c in ("c1", "c1", "c2")]
    row = validated(spark, output(topics=[topic(keywords_in_text=kws, confidence=0.1), topic(), topic(label_id="CONTRATTO")])).first()
    assert [t.label_id for t in row.topics] == ["RECLAMO", "CONTRATTO"] and [k.candidate_id for k in row.topics[0].keywords_in_text] == ["c1", "c2"]
    assert sorted(w.split(" ")[0] for w in row.warnings) == ["Duplicate", "Duplicate", "Very"]
    assert "INVALID" not in validated(spark, output()).select(classify.report(None).alias("r")).first().r


def test_confidence(spark):
    rows = validated(spark, output(topics=[topic(evidence=[{"quote": "a"}, {"quote": "b"}]), topic(label_id="CONTRATTO")]))
    k = classify.exploded_keywords(rows)
    cands = frame(spark, [(0, "c1", 0.6)], "doc_id long, candidate_id string, composite_score double")
    got = {r.label_id: r for r in classify.adjusted_confidence(k, cands, classify.collision_index(k)).collect()}
    assert got["RECLAMO"].confidence_adjusted == pytest.approx(0.3 * 0.8 + 0.4 * 0.6 + 0.2 * 1 + 0.1 * 0.5)
    assert got["CONTRATTO"].evidence_score == 0.5
    lexicon = frame(spark, [("l", "GARANZIA")], "lemma string, label_id string")
    assert classify.collision_index(k, lexicon).first().labels == ["CONTRATTO", "GARANZIA", "RECLAMO"]
    zero = frame(spark, [(1, 0.4, 0.0), (2, 0.9, 0.1), (3, 0.1, None)], "i int, confidence double, confidence_adjusted double")
    assert [r.i for r in classify.confident(zero).collect()] == [1]


# Dictionary


def observed(spark, rows):
    return frame(spark, rows, "label_id string, lemma string, message_id string, term string, count int, embedding_score double")


def test_promotion(spark):
    rows = [("F", "fattura", f"m{i}", t, c, 0.8) for i, (t, c) in enumerate([("fattura", 2), ("fatture", 1), ("Fattura", 3)])]
    rows += [("F", "problema", "m1", "problema", 3, 0.3), ("F", "problema", "m2", "problemi", 3, 0.3), ("F", "raro", "m1", "raro", 1, 0.9), ("F", "raro", "m2", "raro", 1, 0.9)]
    rows += [(x, "documento", f"m{i}", "documento", 3, 0.9) for x in "FGH" for i in range(3)] + [("F", "debole", f"m{i}", "debole", 3, 0.1) for i in range(3)] + [("F", "vuoto", f"m{i}", "vuoto", 3, None) for i in range(3)]
    stats = dictionary.keyword_stats(observed(spark, rows))
    one = stats.filter("lemma = 'fattura'").first()
    assert (one.doc_freq, one.total_count, one.surface_forms) == (3, 6, ["Fattura", "fattura", "fatture"]) and one.avg_embedding_score == pytest.approx(0.8)
    got = sorted((r.label_id, r.lemma, r.decision, r.reason or "") for r in dictionary.promote(stats).collect())
    assert got == sorted(
        [("F", "fattura", "regex_active", ""), ("F", "fattura", "ner_active", ""), ("F", "problema", "ner_active", ""), ("F", "raro", "rejected", "low_count"), ("F", "debole", "quarantined", "insufficient_evidence"), ("F", "vuoto", "quarantined", "insufficient_evidence")]
        + [(x, "documento", "quarantined", "high_collision") for x in "FGH"]
    )
    lax = dictionary.promote(stats, Settings(max_labels=5)).filter("lemma = 'documento'").first()
    assert lax.reason == "moderate_collision"


def test_collisions(spark):
    rows = frame(spark, [("x", "A"), ("x", "B"), ("x", "C"), ("y", "A"), ("y", "B"), (None, "A"), ("z", None), ("", "A")], "lemma string, label_id string")
    assert [(r.lemma, r.labels) for r in dictionary.collisions(rows).collect()] == [("x", ["A", "B", "C"])]
    stats = frame(spark, [("A", "x", 0.5), ("B", "x", 0.8), ("C", "x", 0.8), ("A", "y", 0.1)], "label_id string, lemma string, avg_embedding_score double")
    assert [(r.lemma, r.winner) for r in dictionary.resolve_by_score(stats).collect()] == [("x", "B")]


def test_safe_regex(spark):
    import re

    row = frame(spark, [(["a.b", "c+d", "città"],), ([],)], "f array<string>").select(dictionary.safe_regex(F.col("f")).alias("r")).collect()
    assert re.findall(row[0].r, "A.B axb c+d città") == ["A.B", "c+d", "città"]
    assert not re.search(row[1].r, "anything") and not re.search(row[0].r, "axb")


def test_offline_relevance(spark):
    from postsieve.operators import relevance

    words = "fattura errata fattura del cliente rimborso".split()
    got = relevance.relevant(words, 2, top=4, stop=frozenset(["del"]))
    names = sorted({"fattura", "errata", "cliente", "rimborso", "fattura errata", "errata fattura", "fattura cliente", "cliente rimborso"})
    assert len(got) == 4 and set(k for k, _ in got) <= set(names) and all(-1 <= x <= 1 for _, x in got)
    # The choice again, term by term.
    unit = lambda v: v / (sum(x * x for x in v) ** 0.5)
    vec = {t: unit(sum(relevance.vector(w) for w in t.split())) for t in names}
    doc = unit(sum(relevance.vector(w) for w in words if w != "del"))
    chosen = []
    while len(chosen) < 4:
        worth = {t: 0.3 * float(vec[t] @ doc) - (0.7 * max(float(vec[t] @ vec[c]) for c in chosen) if chosen else 0) for t in names if t not in chosen}
        chosen.append(max(worth, key=worth.get))
    assert [k for k, _ in got] == chosen and got[0][1] == pytest.approx(float(vec[chosen[0]] @ doc), abs=1e-3)
    docs = frame(spark, [(1, "Fattura", "la fattura errata del cliente"), (2, None, None)], "doc_id long, subject string, body string")
    rows = candidates.extract(docs, scorer=relevance.scorer()).collect()
    assert {r.doc_id for r in rows} == {1} and any(r.embedding_score > 0 for r in rows) and relevance.relevant([], 3) == []
    assert all(r.composite_score == pytest.approx(0.3 * math.log1p(r["count"]) / 5 + 0.5 * r.embedding_score + 0.2 * (r.source == "subject")) for r in rows)


def test_relevant_candidates_need_no_shuffle_and_rank_among_all(spark):
    from postsieve.operators import relevance

    rng = random.Random(4)
    words = [rng.choice("fatt rimb contr gar sped cons docu 12 del".split()) + rng.choice(["ura", "orso", "atto", "anzia", ""]) for _ in range(400)]
    docs = frame(spark, [(i, " ".join(words[i : i + 5]), " ".join(words[9 * i : 9 * i + 90])) for i in range(20)] + [(50, None, "la"), (51, "gas", None)], "doc_id long, subject string, body string")
    joined = lambda x: scorer(x)  # noqa: E731  (without of_words: joined and ranked by shuffles)
    for s in (Settings(), Settings(weight_embedding=0.0)):
        scorer = relevance.scorer(s=s)
        got = candidates.best(docs, s=s, embedded=scorer.of_words, positive=True)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        key = lambda rows: sorted((r.doc_id, r["rank"], r.source, r.term, r["count"], r.candidate_id, round(r.composite_score, 9), r.embedding_score) for r in rows.collect())
        assert key(got) == key(candidates.extract(docs, s, joined).filter("embedding_score > 0")) and got.count() > 100
        assert key(candidates.extract(docs, s, scorer)) == key(candidates.extract(docs, s, joined))
        assert key(candidates.best(docs, 7, s, embedded=scorer.of_words, positive=True)) == [k for k in key(got) if k[1] <= 7]


def test_relevance_equals_the_plain_choice():
    from postsieve.operators import relevance

    rng = random.Random(5)
    for k in range(12):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(rng.choice([1, 2, 3, 60, 300]))]
        words = [rng.choice(words) for _ in range(rng.choice([1, 2, 40, 400]))]
        got = relevance.relevant(words, 3, top=30)
        names = sorted({" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)})
        table = [[int(x) for x in sum(relevance.vector(w) for w in t.split())] for t in names]
        unit = np.array(table, float)
        unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-300)
        whole = np.sum([relevance.vector(w) for w in words], axis=0).astype(float)
        near, closest, chosen = unit @ whole / np.linalg.norm(whole), None, []
        for _ in range(min(30, len(names))):
            worth = 0.3 * near - (0.7 * closest if chosen else 0)
            worth[chosen] = -np.inf
            i = int(np.flatnonzero(worth >= worth.max() - 1e-12)[0])
            chosen.append(i)
            closest = unit @ unit[i] if closest is None else np.maximum(closest, unit @ unit[i])
        assert [t for t, _ in got] == [names[i] for i in chosen] and [x for _, x in got] == pytest.approx([near[i] for i in chosen], abs=6e-5)
    few = relevance.Vectors(5)
    for words in (["a", "b", "c"], ["c", "d", "e"], ["f", "a"], [*"abcdefgh"], ["h"]):
        assert few.of(words).tolist() == [relevance.vector(w).tolist() for w in words]


def test_pattern_matches(spark):
    texts = frame(spark, [(1, "Fattura 12 e fattura 345"), (2, None)], "doc_id long, text string")
    patterns = frame(spark, [("whole", "[0-9]+"), ("group", "(?i)(fattura) [0-9]"), ("two", "([a-z]+) ([0-9])"), ("bad", "(")], "name string, pattern string")
    got = {(r.doc_id, r.name): r.matches for r in dictionary.pattern_matches(texts, patterns).collect()}
    assert got[1, "whole"] == ["12", "345"] and got[1, "group"] == ["Fattura", "fattura"] and got[1, "two"] == ["attura 1", "fattura 3"] and got[1, "bad"] == [] and got[2, "whole"] == [] and len(got) == 8


def test_tool_schema_accepts_what_validation_does():
    from postsieve.operators.model import tool_schema

    fields = tool_schema()["function"]["parameters"]["properties"]
    assert fields["topics"]["items"]["properties"]["label_id"]["enum"] == list(classify.TOPICS) and fields["topics"]["maxItems"] == 5
    assert set(output()) == set(fields) and set(fields["customer_status"]["required"]) == set(output()["customer_status"])


def test_versions(spark, tmp_path):
    store = dictionary.Versions(spark, f"file://{tmp_path}/lex")
    assert store.current() == 0
    rows = frame(spark, [("A", "x", "regex", "active", 1), ("A", "y", "ner", "active", 2), ("A", "z", "regex", "quarantined", 1)], "label_id string, lemma string, dict_type string, status string, dict_version_added int")
    assert store.publish(rows) == 1 and store.publish(rows.limit(1)) == 2 and store.current() == 2
    assert store.read(1).count() == 3 and tuple(dictionary.frozen(store.read(1), 1).first()) == (1, 1, 0)
    assert [r.lemma for r in dictionary.active(store.read(1), 2, "ner").collect()] == ["y"]


def test_observations(spark):
    k = frame(spark, [(1, "A", "l1", "c1", 2), (1, "A", None, None, None)], "doc_id long, label_id string, lemma string, candidate_id string, count int")
    c = frame(spark, [(1, "c1", "Lemma uno", 0.4)], "doc_id long, candidate_id string, term string, embedding_score double")
    at = F.lit(datetime(2024, 1, 10))
    obs = dictionary.observations(k, c, 1, at)
    assert obs.count() == 1 and obs.first().term == "Lemma uno" and obs.first().obs_id == dictionary.observations(k, c, 1, at).first().obs_id
    assert dictionary.recent(obs, datetime(2024, 1, 31), 30).count() == 1 and dictionary.recent(obs, datetime(2024, 3, 31), 30).count() == 0
    assert dictionary.mark_promoted(obs, obs.select("obs_id")).first().promoted_to_active


# Entities


def naive_merge(found):
    rank = {"regex": 0, "lexicon": 1, "ner": 2}
    kept = []
    for e in sorted(found, key=lambda e: (e[0], -e[1], rank[e[4]], -e[5], e[3], e[2])):
        hit = next((x for x in kept if not (e[1] <= x[0] or x[1] <= e[0])), None)
        if hit is None:
            kept.append(e)
        else:
            a, b = (rank[e[4]], hit[1] - hit[0], -e[5]), (rank[hit[4]], e[1] - e[0], -hit[5])
            better = a[0] < b[0] or a[0] == b[0] and (b[1] > a[1] or b[1] == a[1] and e[5] > hit[5])
            if better:
                kept[kept.index(hit)] = e
    return sorted(kept, key=lambda e: e[0])


def test_merge_equals_plain_iteration(spark):
    rng = random.Random(3)
    rows = []
    for doc in range(150):
        for k in range(rng.randrange(1, 9)):
            start = rng.randrange(20)
            rows.append((doc, start, start + rng.randrange(1, 9), f"t{k}", rng.choice("ab"), rng.choice(["regex", "lexicon", "ner"]), rng.choice([0.5, 0.75, 0.9])))
    got = entities.merged(frame(spark, rows, "doc_id long, start int, end int, text string, label string, source string, confidence double")).collect()
    for r in got:
        assert [tuple(e) for e in r.entities] == naive_merge([x[1:] for x in rows if x[0] == r.doc_id])


def test_extraction(spark):
    texts = frame(spark, [(1, "F", "Fattura n. 123 e fattura n. 456, test testing attest TEST"), (2, "G", "fattura"), (3, "F", None)], "doc_id long, label_id string, text string")
    regex = frame(spark, [("F", "fattura", r"(?i)\b(fattura)\b"), ("F", "rotto", "(?P<unclosed"), ("F", "senza", None)], "label_id string, lemma string, regex_pattern string")
    found = entities.by_regex(texts, regex).collect()
    assert sorted((r.doc_id, r.start, r.end, r.label) for r in found) == [(1, 0, 7, "fattura"), (1, 17, 24, "fattura")]
    forms = frame(spark, [("F", "test", ["test", "Test"]), ("F", "aa", ["n. 1"])], "label_id string, lemma string, surface_forms array<string>")
    hits = sorted((r.start, r.end, r.text) for r in entities.by_lexicon(texts, forms).collect())
    assert hits == [(33, 37, "test"), (53, 57, "TEST")]
    assert [e.label for e in entities.extract(texts, regex, forms).filter("doc_id = 1").first().entities] == ["fattura", "fattura", "test", "test"]


def test_overlapping_forms(spark):
    texts = frame(spark, [(1, "A", "a a a")], "doc_id long, label_id string, text string")
    forms = frame(spark, [("A", "x", ["a a"])], "label_id string, lemma string, surface_forms array<string>")
    assert sorted(r.start for r in entities.by_lexicon(texts, forms).collect()) == [0, 2]


# Evaluation


def test_topic_scores(spark):
    truth = frame(spark, [(1, "A"), (1, "B"), (2, "A"), (3, "B")], "doc_id long, label_id string")
    guess = frame(spark, [(1, "A"), (2, "B"), (3, "B"), (3, "C")], "doc_id long, label_id string")
    row = evaluate.topics(truth, guess, 3, 3).first()
    a, b = 2 / 3, 2 / 4
    assert row.micro_f1 == pytest.approx(4 / 8) and row.macro_f1 == pytest.approx((a + b + 0) / 3) and row.hamming_loss == pytest.approx(4 / 9)


def test_kappa(spark):
    rng = random.Random(1)
    names = signals.PRIORITIES
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(300)]
    row = evaluate.priority(frame(spark, pairs, "y_true string, y_pred string")).first()
    o = [(names.index(a), names.index(b)) for a, b in pairs]
    seen = sum(abs(a - b) for a, b in o) / len(o)
    expected = sum(abs(a - b) for a, _ in o for _, b in o) / len(o) ** 2
    assert row.kappa == pytest.approx(1 - seen / expected) and row.under_triage_rate == pytest.approx(sum(a - b >= 2 for a, b in o) / len(o))


@pytest.mark.parametrize("x, dof, p", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (7.814728, 3, 0.05), (18.307038, 10, 0.05), (16.918978, 9, 0.05), (0.0, 4, 1.0)])
def test_chi_square_tail(spark, x, dof, p):
    row = frame(spark, [(x, dof)], "x double, d int").select(evaluate.chi_square_tail(F.col("x"), F.col("d")).alias("p")).first()
    assert row.p == pytest.approx(p, abs=1e-5)


def test_drift(spark):
    rows = lambda a, b: frame(spark, [("x",)] * a + [("y",)] * b, "label_id string")
    row = evaluate.chi_square(rows(30, 10), rows(10, 30)).first()
    assert row.chi2 == pytest.approx(18.05) and row.drift_detected
    assert not evaluate.chi_square(rows(10, 10), rows(11, 9)).first().drift_detected


def test_health_and_queue(spark):
    lexicon = frame(spark, [("A", "x", "active", 4, "ner"), ("B", "x", "active", 2, "ner"), ("A", "y", "quarantined", 1, "ner")], "label_id string, lemma string, status string, doc_freq long, dict_type string")
    row = evaluate.dictionary_health(lexicon).first()
    assert (row.entries, row.active_keywords, row.multi_label_keywords, row.collision_rate, row.doc_freq_p50) == (3, 2, 1, 0.5, 2.0)
    assert tuple(evaluate.churn(lexicon.limit(2), lexicon.filter("lemma = 'y'")).first())[1] == 2
    topics = frame(spark, [(1, "A", 0.2), (2, "UNKNOWN_TOPIC", 0.7), (3, "A", 0.9)], "doc_id long, label_id string, confidence double")
    assert sorted(r.reason for r in evaluate.review_queue(topics).collect()) == ["confident_unknown", "low_confidence"]
    a = frame(spark, [(1, ["A", "B"]), (2, ["A"])], "doc_id long, labels array<string>")
    b = frame(spark, [(1, ["B", "A"]), (2, ["B"])], "doc_id long, labels array<string>")
    assert evaluate.agreement(a, b).first().topic_agreement == 0.5
