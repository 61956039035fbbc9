"""Queries of the problems on training text (3, 4, 8, 9, 10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrail.llm.formatting_copies import copy_counts, formatting_copies
from veritrail.llm.leaks import leak_report, leaked_passages
from veritrail.llm.packing import RANKS, packed, packing_report, token_counts
from veritrail.llm.personal import personal_spans, redacted
from veritrail.llm.truncation import cut_texts, truncation_report
from veritrail.operators.shared import stage
from veritrail.sources.tables import table, texts


def _messages(spark: SparkSession, root: str) -> DataFrame:
    turns = texts(spark, root, "turns", "turn_id", "text").select(F.lit("turns").alias("src"), F.col("turn_id").alias("rec_id"), "text")
    return turns.unionByName(texts(spark, root, "rejections", "rejection_id", "text").select(F.lit("rejections").alias("src"), F.col("rejection_id").alias("rec_id"), "text"))


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return personal_spans(_messages(spark, root))


def p3_redacted(spark: SparkSession, root: str) -> DataFrame:
    messages = _messages(spark, root)
    return redacted(messages, personal_spans(messages))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return formatting_copies(texts(spark, root, "raw_facts", "raw_id", "corpus", "payload"), "raw_id", "corpus", "payload")


def p4_copies(spark: SparkSession, root: str) -> DataFrame:
    return copy_counts(table(spark, root, "raw_facts", "raw_id"), "raw_id", p4_found(spark, root))


def p8_packed(spark: SparkSession, root: str) -> DataFrame:
    sizes = {r["size_id"]: r["capacity"] for r in table(spark, root, "context_sizes", "size_id", "capacity").collect()}  # a fixed table
    # the vocabulary file must lie at one path on all executors; the setting names another path
    ranks = spark.conf.get("spark.veritrail.tokenizer", RANKS)
    counts = stage(token_counts(texts(spark, root, "documents", "doc_id", "text"), "doc_id", "text", ranks), "tokens")
    return packed(counts, "doc_id", sizes)


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    return packing_report(p8_packed(spark, root), table(spark, root, "context_sizes"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return leaked_passages(texts(spark, root, "documents", "doc_id", "text"), "doc_id", "text", table(spark, root, "eval_items", "item_id", "text"), "item_id", "text")


def p9_items(spark: SparkSession, root: str) -> DataFrame:
    return leak_report(p9_found(spark, root), "item_id")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return cut_texts(texts(spark, root, "documents", "doc_id", "text", "source"), "doc_id", "text", "source").select("doc_id")


def p10_sources(spark: SparkSession, root: str) -> DataFrame:
    docs = texts(spark, root, "documents", "doc_id", "text", "source")
    return truncation_report(docs, cut_texts(docs, "doc_id", "text", "source"), "source")


QUERIES = {f.__name__: f for f in (p3_found, p3_redacted, p4_found, p4_copies, p8_packed, p8_report, p9_found, p9_items, p10_found, p10_sources)}

_COPIES = r"""
WITH fields AS (
  SELECT raw_id, corpus,
    CASE WHEN payload LIKE '{%' THEN json_extract_string(payload, '$.subject') ELSE regexp_extract(payload, '(?:^|\n)subject:([^\n]*)', 1) END AS f1,
    CASE WHEN payload LIKE '{%' THEN json_extract_string(payload, '$.predicate') ELSE regexp_extract(payload, '(?:^|\n)predicate:([^\n]*)', 1) END AS f2,
    CASE WHEN payload LIKE '{%' THEN json_extract_string(payload, '$.object') ELSE regexp_extract(payload, '(?:^|\n)object:([^\n]*)', 1) END AS f3,
    CASE WHEN payload LIKE '{%' THEN json_extract_string(payload, '$.text') ELSE regexp_extract(payload, '(?:^|\n)text:([^\n]*)', 1) END AS f4
  FROM raw_facts),
plain AS (
  SELECT raw_id, corpus, regexp_replace(lower(f1), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS f1, regexp_replace(lower(f2), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS f2,
    regexp_replace(lower(f3), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS f3, regexp_replace(lower(f4), '[^\p{L}\p{M}\p{N}]+', '', 'g') AS f4
  FROM fields),
pairs AS (SELECT DISTINCT min(raw_id) OVER (PARTITION BY corpus, f1, f2, f3, f4) AS keep_id, raw_id AS copy_id FROM plain)
"""

_LEAKS = r"""
WITH parts AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM eval_items),
runs AS (SELECT side, id, array_to_string(w[k:k + 12], ' ') AS run FROM (SELECT side, id, w, unnest(range(1, len(w) - 11)) AS k FROM parts WHERE len(w) >= 13)),
found AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i ON d.run = i.run AND d.side = 'd' AND i.side = 'i')
"""

ORACLES = {
    "p4_found": _COPIES + "SELECT keep_id, copy_id FROM pairs WHERE keep_id <> copy_id",
    "p4_copies": _COPIES + "SELECT keep_id, count(*) AS copies FROM pairs GROUP BY keep_id",
    "p9_found": _LEAKS + "SELECT doc_id, item_id FROM found",
    "p9_items": _LEAKS + "SELECT item_id, count(*) AS documents FROM found GROUP BY item_id",
}
