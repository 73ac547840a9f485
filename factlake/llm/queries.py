"""The registered queries of this package, each over its whole tables, and
their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm.decontaminate import find_leaks
from factlake.llm.language_id import held_out, identify, learn_profiles, learned_from
from factlake.llm.line_dedup import dedup_report
from factlake.llm.merkle import folded, leaf, manifest, manifest_sql, proof_digest
from factlake.llm.mixing import count_words, mix, mix_sql, taken_words
from factlake.llm.near_dedup import near_duplicates
from factlake.llm.piece_codec import encode_pieces
from factlake.llm.quality_rules import judge, learn_rules, measure
from factlake.llm.quotes import reply_order
from factlake.llm.sharding import assign_shards, read_shards, shards_sql, write_shards
from factlake.llm.texts import ship
from factlake.llm.token_counts import count_tokens
from factlake.llm.token_files import digest, token_path, write_tokens
from factlake.llm.whitening import whiten
from factlake.operators.scale import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 1024
END_ID = 2
SHARD_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    profiles = learn_profiles(documents.filter(learned_from()))
    found = identify(documents, profiles)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = measure(table(spark, sf_dir, "documents"))
    rules = learn_rules(measured, table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(measured, rules).select("doc_id", *counts, "base_failed", "kept")


def op4_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_path(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, WORD_VOCABULARY, END_ID)
    return digest(spark, path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, path = F.octet_length("text"), scratch_path(spark, "shards")
    write_shards(assign_shards(table(spark, sf_dir, "documents"), size, SHARD_BYTES), path)
    return read_shards(spark, path, size, SHARD_BYTES).select("doc_id", "n_bytes", "depth", "shard")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.try_add("n_chars", F.lit(1)) if f == "n_chars" else F.col(f) for f in fields]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    tampered = F.when(chosen, leaf(changed))
    rows = manifest(
        documents, "doc_id", "lang", fields, keep={"doc_id": F.col("doc_id"), "tampered": tampered}
    )
    shown = F.coalesce(F.lower(F.hex("tampered")), "leaf")
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(shown, F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), count_words(F.col("text")))
    return mixed.select("doc_id", "size", "source_size", "target", taken_words().alias("taken"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_quotation_links": op4_quotation_links,
    "op5_line_dedup": op5_line_dedup,
    "op6_piece_codec": op6_piece_codec,
    "op7_token_files": op7_token_files,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_mix": op12_source_mix,
    "op13_embedding_whitening": op13_embedding_whitening,
}

# crc32 of the decimal id, bit by bit.
CRC_SQL = """xor(4294967295, list_reduce(
  [4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
  lambda crc, byte: list_reduce([xor(crc, byte)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
    lambda x, step: xor(x >> 1, (x & 1) * 3988292384))))"""

SQL: dict[str, str] = {
    "op8_sharding": shards_sql(SHARD_BYTES),
    "op11_merkle_manifest": manifest_sql(
        ["doc_id", "source", "lang", "n_chars", "text"],
        ["doc_id", "source", "lang", "(n_chars + 1)", "text"],
        f"{CRC_SQL} % 7 = 0",
    ),
    "op12_source_mix": mix_sql(),
}
