"""The registered queries of the text operators: each runs one operator over its whole table.

The operators return texts, ids and spans; the queries take digests of them.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubline.llm import (
    chunk_dedup, conversations, exact_dedup, lm, nbsvm, packing, pieces, pii, quality_rules, simhash, spelling,
    suffix_dedup, wrappers,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is: in the folder ``SCRUBLINE_TOKENIZERS`` names, or else with its package."""
    if folder := os.environ.get("SCRUBLINE_TOKENIZERS"):
        return str(Path(folder) / name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def _sha256(binary) -> Column:
    return F.sha2(binary, 256)


@_query("op1_nbsvm_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    docs, labels = _documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    model = nbsvm.fit(docs, labels, "quality", learn=~held_out)
    return nbsvm.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@_query("op2_gear_chunks")
def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_dedup.drop_repeats(_documents(spark, folder)).select(
        "doc_id", "n_bytes", "n_removed", "n_chunks", "n_repeated", _sha256("kept").alias("kept_sha256"),
        F.coalesce("first_keys", F.array().cast("array<bigint>")).alias("first_doc_ids"),
    )


@_query("op3_simhash_groups")
def near_copies(spark: SparkSession, folder: str) -> DataFrame:
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return simhash.near_groups(_documents(spark, folder), shingle=3, radius=2).select(
        "doc_id", fingerprint, "component_id"
    )


@_query("op4_sentencepiece")
def sentencepieces(spark: SparkSession, folder: str) -> DataFrame:
    model = Path(tokenizer_path("piece_bpe_32k.model")).read_bytes()
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return pieces.encode(_documents(spark, folder), model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha256(ids).alias("ids_sha256"),
        _sha256("decoded").alias("decoded_sha256"), F.element_at("ends", -1).cast("long").alias("n_bytes"),
    )


@_query(
    "op5_exact_groups",
    r"""
    WITH d AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents
    )
    SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           doc_id = min(doc_id) OVER g AS kept, text_sha256
    FROM d WINDOW g AS (PARTITION BY text_sha256)
    """,
)
def exact_copies(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(_documents(spark, folder)).drop("historical")


def spans_text(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    kind = F.array(*map(F.lit, pii.KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(kind, x["kind"] + 1), x["s"], x["e"])
    return F.array_join(F.transform(spans, one), ",")


@_query("op6_pii_spans")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.candidates(_documents(spark, folder))
    spans = pii.find(found, pii.train(found))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{pii.KINDS[kind]}")

    return spans.select(
        "doc_id", *[count(k) for k in range(len(pii.KINDS))], _sha256(spans_text("base")).alias("base_sha256"),
        spans_text("spans").alias("spans"),
    )


@_query("op7_suffix_dedup")
def substrings(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.drop_repeats(_documents(spark, folder), length=50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", _sha256("kept").alias("kept_sha256")
    )


@_query("op8_maxent_lm")
def language_model(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(_remainder(7) == 2, F.lit(False))
    return lm.score(_documents(spark, folder), ~held_out).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@_query("op9_packing")
def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, folder), tokenizer_path("byte_bpe_50k.json"), capacity=2048)


@_query(
    "op10_quality_rules",
    r"""
    WITH w AS (
      SELECT doc_id, coalesce(text, '') AS t,
             list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(coalesce(text, ''), chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM documents
    ), windows AS (
      SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] || ' '
                        || words[i + 4] AS five
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)
    ), twice AS (
      SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, five) > 1
    ), repeated AS (
      SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM twice CROSS JOIN (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id
    ), figures AS (
      SELECT w.doc_id, len(words) AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
             len(list_filter(words, lambda x: regexp_full_match(x, '[0-9]+'))) AS n_digit_words
      FROM w LEFT JOIN repeated USING (doc_id)
    ), judged AS (
      SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM figures
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT (
             10 * n_symbols > 3 * n_words OR NOT word_chars BETWEEN 2 * n_words AND 25 * n_words
             OR 100 * n_dup_lines > 30 * n_lines OR 10 * n_digit_words > 5 * n_words) AS kept
    FROM judged
    """,
)
def rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, folder))


@_query("op11_spelling_variants")
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(spelling.count_words(spelling.misspelt(spelling.runs(_documents(spark, folder)))))


@_query("op12_main_text")
def main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return wrappers.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@_query("op13_conversation_repair")
def conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    return conversations.repair_digests(conversations.damage(turns), turns)
