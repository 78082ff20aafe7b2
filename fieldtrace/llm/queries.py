"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrace.llm.common import table
from fieldtrace.llm.decontaminate import find_contamination
from fieldtrace.llm.language import fit_language_network, held_out, predict_language
from fieldtrace.llm.licenses import scan_licenses
from fieldtrace.llm.mixing import score_texts
from fieldtrace.llm.near_dups import near_duplicate_classes
from fieldtrace.llm.packing import pack_documents
from fieldtrace.llm.pii import find_personal_data
from fieldtrace.llm.repair import damaged, repair_report
from fieldtrace.llm.spelling import DAMAGE, spelling_variants
from fieldtrace.llm.substrings import remove_repeats
from fieldtrace.llm.token_files import read_token_files, write_token_files
from fieldtrace.llm.toxicity import fit_tagger, score_toxicity
from fieldtrace.llm.vector_search import top_inner_products


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near-duplicate texts of every document."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document written to seekable files and read back."""
    manifest = write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)
    return read_token_files(manifest, with_ids=False)


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every vector whose id is divisible by 20 with all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_inner_products(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in every document."""
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
OP4_SQL = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS l, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS t
  FROM items, unnest(range(0, len(w) - least(10, len(w)) + 1)) u(i) WHERE len(w) > 0),
places AS (
  SELECT r, i, l, array_to_string(w[i + 1 : i + l], ' ') AS t
  FROM docs, (SELECT DISTINCT l FROM windows), unnest(range(0, len(w) - l + 1)) u(i)),
hits AS (SELECT DISTINCT r, i, p.l, item_id FROM places p JOIN windows b ON p.l = b.l AND p.t = b.t),
covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, l FROM hits), unnest(range(0, l)) u(k) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""


def op5_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of 200-byte strings that also start elsewhere, all copies removed."""
    return remove_repeats(table(spark, sf_dir, "documents"), keep_first=False).drop("kept")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; documents whose crc32 leaves 2 modulo 4 are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 4, 2))
    net = fit_language_network(docs.where("not held_out"))
    return predict_language(docs.select("doc_id", "text", "held_out"), net).select("doc_id", "held_out", "lang_pred", "score")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0, room=2048)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; documents whose crc32 leaves 1 modulo 3 are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1))
    scored = score_toxicity(docs.withColumn("held_out", held_out("doc_id", 3, 1)), fit_tagger(docs, labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and disguised identifiers in every document."""
    return find_personal_data(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the damage to one row in four."""
    rows = table(spark, sf_dir, "conversations")
    return repair_report(damaged(rows), rows)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent near word and root of every word, after the damage to one occurrence in 199."""
    return spelling_variants(table(spark, sf_dir, "documents"), damage=DAMAGE)


def op13_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document; documents whose crc32 leaves 2 modulo 7 are not learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id", 7, 2))
    return score_texts(docs, group="lang")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_near_duplicates, op2_token_files, op3_vector_search, op4_benchmark_decontamination, op5_repeated_substrings, op6_licenses, op7_language, op8_best_fit_packing,
                          op9_toxicity, op10_personal_data, op11_conversation_repair, op12_spelling_variants, op13_model_scores)
}
ORACLE_SQL: dict[str, str] = {"op3_vector_search": OP3_SQL, "op4_benchmark_decontamination": OP4_SQL}
