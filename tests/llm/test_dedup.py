import hashlib
import random
import re

import pytest

from conftest_llm import prose
from postsieve.llm.components import components
from postsieve.llm import exact_dedup as exact
from postsieve.llm.exact_dedup import exact_dedup
from postsieve.llm.near_dedup import candidates, near_dedup


real = exact.F.xxhash64


def by_hand(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    least, n = {}, {}
    for i in sorted(norm):
        least.setdefault(norm[i], i)
        n[norm[i]] = n.get(norm[i], 0) + 1
    return sorted((i, least[t], n[t], least[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items())


def test_exact(docs):
    rng = random.Random(1)
    texts = ["a b", "a  b", "a\t\nb", " a b", "A b", "", None, " ", "\n", "è ü", "x" * 300_000, "x" * 300_000 + " ", "a b"]
    rows = list(enumerate(texts)) + [(100 + i, rng.choice(texts)) for i in range(60)]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in exact_dedup(docs(rows)).collect())
    assert got == by_hand(rows)


def test_exact_hot_group_is_dealt(docs, monkeypatch):
    """Groups of a third of all rows and of long texts go to several runs, whose first rows are compared on the whole text."""
    monkeypatch.setattr(exact, "ROWS", 20)
    monkeypatch.setattr(exact, "BYTES", 5000)
    rows = [(i, ["same  text", "same\ttext", f"own {i}"][i % 3]) for i in range(600)] + [(1000 + i, "y" * 900) for i in range(30)]
    assert sorted(tuple(r) for r in exact_dedup(docs(rows)).collect()) == by_hand(rows)


def test_exact_equality_is_not_that_of_hashes(docs, monkeypatch):
    """With one hash for all texts of the same first letters, groups are still those of equal texts."""
    monkeypatch.setattr(exact, "ROWS", 20)
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: exact.F.lit(7) if c == ("norm",) else real(*c))
    rows = [(i, f"{'prefix ' * 4}{i % 7 if i % 2 else 'one'}") for i in range(200)]
    assert sorted(tuple(r) for r in exact_dedup(docs(rows)).collect()) == by_hand(rows)


def test_exact_plan_is_native(docs):
    plan = exact_dedup(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_exact_odd_ids(docs):
    rows = [(None, "a"), (5, "a"), (5, "a"), (None, "b"), (None, "b"), (7, "a")]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs(rows)).collect()), key=str)
    assert got == sorted([(None, 5, 4, False), (5, 5, 4, True), (5, 5, 4, True), (7, 5, 4, False), (None, None, 2, True), (None, None, 2, True)], key=str)


def test_exact_empty(docs):
    assert exact_dedup(docs([]).filter("false")).count() == 0


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def linked(rows, k, percent=80):
    sets = {i: shingles(t, k) for i, t in rows}
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both * 100 >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("k", [4, 5])
def test_near_equals_all_pairs(docs, k):
    rng = random.Random(k)
    rows, at = [], 0
    for group in range(12):
        base = prose(rng, rng.choice([3, 8, 30, 120, 400]))
        for _ in range(rng.choice([1, 2, 5, 25])):
            rows.append((at, edited(rng, base, rng.randrange(6))))
            at += 1
    passage = prose(rng, 60)
    rows += [(at + i, passage + " " + prose(rng, rng.randrange(5, 200))) for i in range(40)]
    rows += [(900, None), (901, ""), (902, " \n "), (903, "uno"), (904, "UNO"), (905, "uno due"), (906, "à b c d"), (907, "À b c d")]
    rng.shuffle(rows)
    got = sorted(tuple(r) for r in near_dedup(docs(rows), words=k).collect())
    assert got == linked(rows, k)


def test_near_large_group_and_chain(docs):
    """A group with a third of all rows, some of it only linked through others, and a chain of small steps."""
    rng = random.Random(9)
    base = prose(rng, 90)
    rows = [(i, edited(rng, base, rng.randrange(8))) for i in range(150)]
    step = prose(rng, 100).split()
    for i in range(12):
        rows.append((500 + i, " ".join(step)))
        step = step[4:] + prose(rng, 4).split()
    rows += [(700 + i, prose(rng, 50)) for i in range(200)]
    assert sorted(tuple(r) for r in near_dedup(docs(rows), words=4).collect()) == linked(rows, 4)


def test_near_hot_keys(docs, monkeypatch):
    """Small shares count as hot, so values, hubs, shingles and classes go the way of hot keys; the needed sets are joined instead of told by a map."""
    from postsieve.llm import near_dedup as module
    from postsieve.llm import skew

    monkeypatch.setattr(skew, "HOT", 40)
    monkeypatch.setattr(skew, "UNIT", 2)
    rng = random.Random(4)
    base, shared = prose(rng, 60), prose(rng, 45)
    rows = [(i, edited(rng, base, rng.randrange(9))) for i in range(80)] + [(200 + i, f"{shared} {prose(rng, 12)}") for i in range(60)] + [(300 + i, base) for i in range(30)]
    want = linked(rows, 4)
    assert sorted(tuple(r) for r in near_dedup(docs(rows), words=4).collect()) == want
    monkeypatch.setattr(module, "MAP_BITS", 4)
    assert sorted(tuple(r) for r in near_dedup(docs(rows), words=4).collect()) == want


def sets_of(spark, rows, labels):
    sets = {i: shingles(t, 4) for i, t in rows}
    apart = spark.createDataFrame([(i, len(s), labels(i)) for i, s in sets.items()], "node long, n long, label long")
    hashed = spark.createDataFrame([(i, len(s), labels(i), [hash(x) for x in s]) for i, s in sets.items()], "node long, n long, label long, s array<long>")
    return sets, apart, hashed


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_candidates_hold_all_links(spark, percent):
    """Without the sketches before it: both ends of every link of two labels are candidates."""
    rng = random.Random(percent)
    rows = []
    for g in range(6):
        base = prose(rng, rng.choice([2, 9, 40, 120]))
        rows += [(100 * g + i, edited(rng, base, rng.randrange(12 if percent < 80 else 3)) + rng.choice(["", " " + prose(rng, 3)])) for i in range(25)]
    sets, apart, hashed = sets_of(spark, rows, lambda i: i % 3)
    got = {r.node for r in candidates(apart, hashed, percent).collect()}
    ids = sorted(sets)
    want = [(i, j) for i in ids for j in ids if i < j and i % 3 != j % 3 and len(sets[i] & sets[j]) * 100 >= percent * len(sets[i] | sets[j])]
    assert {x for pair in want for x in pair} <= got and len(want) > 10


def test_boilerplate_leaves_no_candidates(spark):
    """Documents that share three quarters of their words, but no more: none is compared with another."""
    rng = random.Random(8)
    shared = prose(rng, 120)
    _, apart, hashed = sets_of(spark, [(i, f"{shared} {' '.join(str(rng.random()) for _ in range(40))}") for i in range(80)], lambda i: i)
    assert candidates(apart, hashed, 80).count() == 0


def test_near_halo_of_a_group(docs, monkeypatch):
    """Copies of one origin with many edits: some linked, some not quite; small blocks, so that they meet in many tasks."""
    from postsieve.llm import near_dedup as module

    monkeypatch.setattr(module, "BLOCK", 8)
    monkeypatch.setattr(module, "COLUMNS", 16)
    rng = random.Random(14)
    base = prose(rng, 120)
    rows = [(i, edited(rng, base, rng.randrange(14))) for i in range(120)]
    assert sorted(tuple(r) for r in near_dedup(docs(rows), words=4).collect()) == linked(rows, 4)


def test_near_complementary_words(docs):
    from test_tokens_packing import thue_morse

    rows = list(enumerate(w for n in (1024, 2048, 4096) for pair in ("ab", "eq") for w in thue_morse(n, pair)))
    assert sorted(tuple(r) for r in near_dedup(docs(rows)).collect()) == [(i, 1, i, True) for i, _ in rows]


def test_near_very_long_texts(docs):
    rng = random.Random(3)
    long = " ".join(f"{rng.randrange(10**9):x}" for _ in range(60_000))
    rows = [(1, long), (2, edited(rng, long, 300)), (3, long[: len(long) // 2]), (4, "x" * 1_000_000), (5, "x" * 1_000_001)]
    assert sorted(tuple(r) for r in near_dedup(docs(rows)).collect()) == linked(rows, 5)


def test_near_odd_ids(docs):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (9, "a b c d e"), (None, None)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup(docs(rows)).collect()), key=str)
    assert got == sorted([(None, None, True), (None, None, True), (3, 3, True), (3, 3, True), (9, 3, False)], key=str)


def test_near_empty(docs):
    assert near_dedup(docs([]).filter("false")).count() == 0
    assert near_dedup(docs([(1, None)])).collect()[0].kept


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(100)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            top[y] = x
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(top)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
