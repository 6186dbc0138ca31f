"""The corpus operators as named queries over the tables of a folder, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .language import fit_profiles, identify_language
from .licenses import scan_licenses
from .near_dedup import near_dedup
from .packing import pack
from .quality import quality
from .secrets import scan_secrets
from .shards import default_folder, materialise
from .tokens import token_counts


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie; a parameter of every operator that reads one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=4, percent=80)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(4) == 2, F.lit(False))
    profiles = fit_profiles(docs, learn=~held_out)
    return identify_language(docs, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return materialise(docs, tokenizer_path("byte_bpe_50k.tiktoken"), default_folder(docs), key=20)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(id_remainder(3) == 1, F.lit(False))
    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_near_dedup, op3_language_id, op4_decontamination, op5_token_shards, op6_token_counts, op7_license_scan, op8_best_fit_packing, op9_secret_scan, op10_quality)
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t
    """,
    # Every pair of sets that share a shingle is counted in full: no sketches, no blocks.
    "op2_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM l),
        s AS (SELECT l.doc_id, n.n, unnest(l.s) AS x FROM l JOIN n ON n.doc_id = l.doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS an, b.n AS bn, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY ALL),
        links AS (SELECT a, b FROM c WHERE shared * 100 >= 80 * (an + bn - shared)),
        reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, k.b FROM reach r JOIN links k ON k.a = r.b),
        top AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT n.doc_id, n.n AS n_shingles, top.component_id, n.doc_id = top.component_id AS kept FROM n JOIN top ON top.a = n.doc_id
    """,
}
