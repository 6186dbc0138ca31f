import random
import re
import zlib

import numpy as np
import pytest
from test_dedup import edited, linked
from test_scans import similarity
from tokenizers import Tokenizer

import corpus_pipeline as p
from conftest_llm import prose
from postsieve.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def folder(spark, tmp_path):
    def make(items):
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def test_stages(spark, docs, folder):
    rng = random.Random(1)
    leak = prose(rng, 40)
    base = prose(rng, 200)
    near = base.replace(base.split()[100], "diverso", 1)
    rows = [(1, base, "it"), (2, base + " ", "it"), (3, f" {base}\n", "it"), (4, near, "it"), (5, prose(rng, 100), "it"), (6, f"{prose(rng, 50)} {leak}", "it"), (7, None, "it"), (8, "123", None), (None, prose(rng, 80), "it"), (9, prose(rng, 90), None), (9, prose(rng, 95), None)]
    where = folder([(1, leak), (2, None)])
    table = docs(rows)
    kept = []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, table, where)
        assert out.schema == table.schema, name
        table = p.written(out)
        kept.append(sorted((r.doc_id for r in table.collect()), key=str))
    # "x " and " x" differ after normalisation, so 2 and 3 go as near copies.
    assert kept[0] == sorted([1, 2, 3, 4, 5, 6, 9, 9, None], key=str) and kept[1] == kept[0]
    assert kept[2] == sorted([1, 5, 6, 9, 9, None], key=str) and kept[3] == sorted([1, 5, 9, 9, None], key=str)
    assert {r.doc_id for r in p.STAGES[-1][1](spark, table, where).collect()} == {1, 5, 9, None}


def test_stages_decide_by_row(spark, docs, folder):
    rng = random.Random(2)
    leak = prose(rng, 40)
    copied, base, clean = prose(rng, 60), prose(rng, 200), [prose(rng, 70) for _ in range(4)]
    near = base.replace(base.split()[100], "diverso", 1)
    null = [(None, x, "it") for x in (clean[0], None, copied, near, f"{prose(rng, 50)} {leak}", clean[1])]
    rows = null + [(3, copied, "it"), (3, copied, "it"), (4, base, "it"), (5, clean[2], "it"), (5, "123", "it"), (5, copied, "it"), (5, f"{leak} {prose(rng, 50)}", "it"), (5, clean[3], "it")]
    where, table = folder([(1, leak)]), docs(rows)
    for _, stage in p.STAGES[:-1]:
        table = p.written(stage(spark, table, where))
    got = sorted(((r.doc_id, r.text) for r in table.collect()), key=str)
    assert got == sorted([(None, clean[0]), (None, clean[1]), (3, copied), (4, base), (5, clean[2]), (5, clean[3])], key=str)


@pytest.mark.parametrize("lang", [None, "und"])
def test_language_stage_without_known_labels(spark, docs, lang):
    rows = [(1, prose(random.Random(3), 30), lang), (2, "è", lang), (3, None, lang), (4, "123 !", lang), (5, "", lang), (None, "a", lang)]
    assert sorted((r.doc_id for r in p.language_id(spark, docs(rows), "").collect()), key=str) == [1, 2, None]


def test_stages_on_no_rows(spark, docs, folder):
    where, table = folder([]), docs([]).filter("false")
    for _, stage in p.STAGES:
        assert stage(spark, table, where).count() == 0


def test_run(spark):
    docs = queries.table(spark, DIR, "documents")
    packed = p.run(spark, DIR)
    ids = {r.doc_id for r in packed.select("doc_id").collect()}
    kept = {r.doc_id for r in queries.op1_exact_dedup(spark, DIR).filter("kept").collect()}
    leaks = {r.doc_id for r in queries.op4_decontamination(spark, DIR).collect()}
    assert ids <= kept and not ids & leaks and len(ids) > 0.5 * docs.count() and packed.agg({"length": "max"}).first()[0] <= 2048
    assert p.ORACLE_SQL is None and [n for n, _ in p.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]


def test_keys_are_the_same_in_all_splits(spark, docs, tmp_path):
    docs([(None, f"t{i}", "it") for i in range(500)]).repartition(5).write.option("parquet.block.size", 2048).parquet(f"{tmp_path}/t")
    read = lambda: p._keyed(spark.read.parquet(f"{tmp_path}/t"))
    first = {r.text: r[p._ROW] for r in read()[0].collect()}
    assert len(set(first.values())) == 500
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert {r.text: r.doc_id for r in read()[1].filter("text is not null").collect()} == first
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def plain_pipeline(rows, items):
    """The (doc_id, text) rows that a plain reading of the stages keeps, each row judged by itself."""
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)
    kept = [i for i, r in enumerate(rows) if r[1] and any(c.isalpha() for c in r[1])]
    seen, first = {}, []
    for i in sorted(kept, key=order):
        seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i][1]), i)
    first = sorted(seen.values(), key=order)
    top = {k: c for k, _, c, _ in linked([(k, rows[i][1]) for k, i in enumerate(first)], 5)}
    kept = [i for k, i in enumerate(first) if top[k] == k]
    return sorted(((rows[i][0], rows[i][1]) for i in kept if not any(t and similarity(rows[i][1], t) >= 0.8 for t in items)), key=str)


def test_run_equals_a_plain_pipeline(spark, docs, tmp_path):
    """Every row of the whole run: copies, near copies, passages, texts without letters; ids that are null or repeated, each beside a good twin."""
    rng = random.Random(21)
    items = [prose(rng, rng.randrange(12, 50)) for _ in range(6)] + [None]
    texts = [prose(rng, rng.randrange(1, 150)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    for k in range(60):
        t = rng.choice(texts)
        i = rng.choice([None, 100 + k, rng.randrange(60)])
        rows.append((i, rng.choice([t, t + " ", edited(rng, t, rng.randrange(4)), f"{prose(rng, rng.randrange(1, 60))} {rng.choice(items[:-1])} {prose(rng, 5)}", prose(rng, 70), "12 34", None, ""])))
    rows += [(None, None), (None, prose(rng, 60)), (3, "77"), (3, prose(rng, 60)), (5, f"{items[0]} {prose(rng, 40)}"), (5, prose(rng, 40))]
    docs([(i, t, "it") for i, t in rows]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = queries.table(spark, str(tmp_path), "documents")
    # Rows in the order in which they are numbered, which decides among rows of equal ids.
    rows = [(r.doc_id, r.text) for r in table.orderBy("_metadata.file_path", "_metadata.row_index").collect()]
    want = plain_pipeline(rows, items)
    for _, stage in p.STAGES[:-1]:
        table = p.written(stage(spark, table, str(tmp_path)))
    assert sorted(((r.doc_id, r.text) for r in table.collect()), key=str) == want
    ids = {}
    for r in p.run(spark, str(tmp_path)).collect():
        assert r.start + r.length <= 2048
        ids.setdefault(r.doc_id, []).append(r.ids_crc32)
    lib = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    crc = {}
    for i, t in want:
        crc.setdefault(i, []).append(zlib.crc32(np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()))
    assert {k: sorted(x) for k, x in ids.items()} == {k: sorted(x) for k, x in crc.items()}


def test_queries_run_and_name_all_operators(spark):
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    got, want = queries.QUERIES[name](spark, DIR), con.sql(queries.ORACLE_SQL[name])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
