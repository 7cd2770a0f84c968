"""The registered queries of the training-data operators; each reads its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from neardup.llm import (
    chat, decontamination, language_id, line_dedup, merkle, minhash, quality, secret_scan, sentencepiece_codec, simhash_tiles,
    spelling, token_counts, token_files)
from neardup.llm.common import table
from neardup.llm.sql import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark, sf_dir):
    found = line_dedup.simhash_verdicts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "line_no", "first_doc_id", "first_line_no", "kept")


@query
def op2_sentencepiece_codec(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_codec.round_trip(docs, "piece_bpe_32k.model")


@query
def op3_token_counts(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), "piece_bpe_32k.model")


@query
def op4_minhash_groups(spark, sf_dir):
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op5_quality_rules(spark, sf_dir):
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality.BASE, "base_failed", "kept")


@query
def op6_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op7_token_files(spark, sf_dir):
    return token_files.write_and_read(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2)


@query
def op8_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark, sf_dir):
    found = decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "verbatim")


@query
def op10_chat_rotation(spark, sf_dir):
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), typo_rate=spelling.TYPO_RATE)


@query
def op12_simhash_tiles(spark, sf_dir):
    found = simhash_tiles.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


@query
def op13_merkle_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = merkle.manifest(table(spark, sf_dir, "documents"),
                            claimed={"text": F.when(tampered, lowered).otherwise(F.col("text"))})
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")
