import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_llm import prose
from postsieve.llm.common import id_remainder, table
from postsieve.llm.language import UNKNOWN, Matcher, fit_profiles, grams, identify_language, ranked
from postsieve.llm.quality import WIDTH, features, fit, posterior, quality, statistics, transform
from postsieve.llm.queries import op3_language_id, op10_quality

DIR = "/root/testdata/sf0.01"


def gram_set(text):
    out = {}
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g.strip() and (n < 3 or g[1] != " "):
                    out[g] = out.get(g, 0) + 1
    return out


def code(g):
    out = 0
    for c in g:
        out = out << 21 | (0 if c == " " else ord(c))
    return out


@pytest.mark.parametrize("text", ["Ciao mondo", "a", "é ü-x 12 ab", "日本語 テスト", "x" * 50, "Straße 𝒜b"])
def test_grams_equal_plain_counting(text):
    values, counts = grams(text)
    want = {}
    for g, n in gram_set(text).items():
        want[code(g)] = want.get(code(g), 0) + n
    assert dict(zip(values.tolist(), counts.tolist())) == want


def test_distance_equals_plain_ranking():
    rng = random.Random(1)
    profiles = {name: ranked(*grams(prose(rng, 80)), 60).tolist() for name in ("a", "b")}
    text = prose(rng, 30)
    own = ranked(*grams(text), 60).tolist()
    far = {n: sum(min(abs(p.index(g) - i), 60) if g in p else 60 for i, g in enumerate(own)) for n, p in profiles.items()}
    name, score = Matcher(profiles, 60).predict(text)
    assert name == min(far, key=far.get) and score == pytest.approx(1 - far[name] / (60 * len(own)))


def test_language_cases(docs):
    rows = [(i, "the cat and the dog went with them to the house", "en") for i in range(4)] + [(10 + i, "il gatto e il cane sono andati nella casa", "it") for i in range(4)]
    rows += [(20, None, "en"), (21, "", "it"), (22, "123 !!", None), (23, "the cat is in the house", None), (None, "il cane nella casa", None), (23, "the cat is in the house", None)]
    profiles = fit_profiles(docs(rows))
    assert list(profiles) == ["en", "it"] and len(profiles["en"]) <= 400
    got = [(r.doc_id, r.lang_pred) for r in identify_language(docs(rows), profiles).collect()]
    assert got[8:] == [(20, UNKNOWN), (21, UNKNOWN), (22, UNKNOWN), (23, "en"), (None, "it"), (23, "en")]
    assert all(0 <= r.score <= 1 for r in identify_language(docs(rows), profiles).collect())
    assert fit_profiles(docs([]).filter("false")) == {} and identify_language(docs(rows), {}).first().lang_pred == UNKNOWN
    assert identify_language(docs([]).filter("false"), profiles).count() == 0
    assert list(fit_profiles(docs(rows), learn=F.col("doc_id") < 5)) == ["en"]
    assert identify_language(docs([(1, "casa " * 100_000)]), profiles).first().lang_pred == "it"


def test_language_sample_is_bounded(docs):
    rng = random.Random(8)
    rows = [(i, prose(rng, 6), "it") for i in range(50)]
    assert fit_profiles(docs(rows), per_language=5) != fit_profiles(docs(rows), per_language=50)
    assert fit_profiles(docs(rows), per_language=5) == fit_profiles(docs(rows[::-1]), per_language=5)


def test_profiles_equal_plain_counting(docs):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(1, 30)) + rng.choice(["", " Ünï", " 12"]), rng.choice(["it", "de", None])) for i in range(80)]
    want = {}
    for name in ("de", "it"):
        counts = {}
        for _, t, lang in rows:
            if lang == name:
                for g, n in gram_set(t).items():
                    counts[code(g)] = counts.get(code(g), 0) + n
        want[name] = sorted(counts, key=lambda g: (-counts[g], g))[:120]
    assert fit_profiles(docs(rows), size=120) == want
    assert fit_profiles(docs(rows), size=120, languages=1) == {k: v for k, v in want.items() if k == max(want, key=lambda n: sum(r[2] == n for r in rows))}


def test_profiles_of_a_language_with_most_rows(docs):
    """A language far beyond the sample and repeated rows: the sample has the least hashes, and no more."""
    rng = random.Random(7)
    rows = [(i, prose(rng, 4), "it") for i in range(3000)] + [(i, f"der hund {i}", "de") for i in range(3000, 3010)] + [(None, "la casa", "it")] * 400
    got = fit_profiles(docs(rows), per_language=20)
    assert set(got) == {"de", "it"} and got == fit_profiles(docs(rows[::-1]).repartition(7), per_language=20)


def test_fit_equals_plain_shrinkage(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, WIDTH)) @ rng.normal(size=(WIDTH, WIDTH)) + rng.normal(size=WIDTH)
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    model = fit(spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "x array<double>, label int").repartition(5), pool=0.2, ridge=0.05)
    own = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    n = [int((y == c).sum()) for c in (0, 1)]
    pooled = (n[0] * own[0] + n[1] * own[1]) / 400
    scale = np.sqrt(np.diag(pooled))
    logs = []
    for c in (0, 1):
        s = (0.8 * own[c] + 0.2 * pooled) / np.outer(scale, scale)
        s = 0.95 * s + 0.05 * np.trace(s) / WIDTH * np.eye(WIDTH)
        d = (x - x[y == c].mean(axis=0)) / scale
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1] + np.log(n[c]))
    assert posterior(model, x) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])), abs=1e-7)


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in table(spark, DIR, "documents").collect()}
    rows = op3_language_id(spark, DIR).collect()
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_statistics():
    x = statistics(b"Ab ab ab\nAb ab ab\nxyz 12.")
    assert x[:3] == [25, 8, 3] and x[13] == 4 / 8 and x[17] == 2 / 3 and len(x) == WIDTH
    assert statistics(None) == statistics(b"") == [0.0] * WIDTH and np.isfinite(transform(np.array([statistics(b" \n"), statistics(b"")]))).all()


def test_quadratic_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    mean = rng.normal(size=(2, WIDTH))
    model = {"scale": np.ones(WIDTH), "prior": 0.3, "classes": []}
    covs = []
    for c in (0, 1):
        a = rng.normal(size=(WIDTH, WIDTH))
        covs.append(a @ a.T + np.eye(WIDTH))
        factor = np.linalg.cholesky(covs[c])
        model["classes"].append((mean[c], np.linalg.inv(factor), float(np.log(np.diag(factor)).sum())))
    x = rng.normal(size=(5, WIDTH))
    log = [-0.5 * np.einsum("ij,jk,ik->i", x - mean[c], np.linalg.inv(covs[c]), x - mean[c]) - 0.5 * np.linalg.slogdet(covs[c])[1] for c in (0, 1)]
    assert posterior(model, x) == pytest.approx(1 / (1 + np.exp(log[0] - log[1] - 0.3)))


def test_fit_sums_equal_plain_sums(spark, docs):
    rng = random.Random(3)
    rows = [(i, prose(rng, 30) if i % 2 else "!!! $$$ " * rng.randrange(3, 9)) for i in range(40)]
    vectors = features(docs(rows))
    x = {r.doc_id: r.x for r in vectors.collect()}
    model = fit(vectors.withColumn("label", (F.col("doc_id") % 2).cast("int")))
    ones = np.array([x[i] for i in range(1, 40, 2)])
    assert model["classes"][1][0] * model["scale"] == pytest.approx(ones.mean(axis=0))
    p = posterior(model, np.array([x[i] for i in range(40)]))
    assert (p[1::2] > 0.5).all() and (p[::2] < 0.5).all()


def test_quality_cases(spark, docs):
    rows = [(i, "una frase buona e lunga con parole diverse" if i % 2 else "$$$ $$$ $$$") for i in range(20)] + [(50, None), (51, ""), (None, "x"), (3, "una frase"), (60, "parola " * 60_000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(50, None), (999, 1), (None, 1), (1, 1)], "doc_id long, quality int")
    got = quality(docs(rows), labels, F.lit(True)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    only = quality(docs(rows), labels.filter("quality = 1"), F.lit(True)).collect()
    assert {r.score for r in only} == {1.0}
    assert {r.score for r in quality(docs(rows), labels.filter("false"), F.lit(True)).collect()} == {0.5}
    assert quality(docs([]).filter("false"), labels, F.lit(True)).count() == 0


def test_quality_held_out(spark):
    truth = {r.doc_id: r.quality for r in table(spark, DIR, "labels").collect()}
    rows = op10_quality(spark, DIR).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    good, bad = [r.score for r in held if truth[r.doc_id]], [r.score for r in held if not truth[r.doc_id]]
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.97


def test_remainders(docs):
    rows = docs([(i, "") for i in range(50)] + [(None, "")]).select("doc_id", id_remainder(4).alias("m")).collect()
    assert all(r.m == (None if r.doc_id is None else zlib.crc32(str(r.doc_id).encode()) % 4) for r in rows)


def test_listed_rows_need_no_python_workers(spark):
    from postsieve.llm.common import listed

    for rows in ([("it", 5), ("è", 1 << 62)], []):
        df = listed(spark, rows, "lang string, most long")
        assert [tuple(r) for r in df.collect()] == rows and df.dtypes == [("lang", "string"), ("most", "bigint")]
        assert "RDD" not in df._jdf.queryExecution().executedPlan().toString()
