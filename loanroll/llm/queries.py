"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanroll.session import scratch_dir

from . import bpe, chat, classifier, decontaminate, merkle, oracle, piece_merges, quality_rules, ranked_search, sharding, simhash, suffix_tree, token_files, wrapper
from .common import table

#: Production parameters.
SHARDS = [f"shard-{i:02d}" for i in range(32)]


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    segments = chat.format_conversations(turns.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json"))
    return chat.conversation_digests(segments).drop("n_tokens", "loss_tokens")


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(suffix_tree.fit(table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), tokenizer), tokenizer)


def op5_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)


def op7_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digests(decontaminate.find_benchmark_spans(documents, benchmark, window=10))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.file_index(token_files.read_token_files(spark, path))


def op9_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def op10_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op11_geometric_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(merkle.manifest(table(spark, sf_dir, "documents"), changed=merkle.tampered()))


def op13_piece_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return piece_merges.digests(piece_merges.encode(table(spark, sf_dir, "documents"), model), model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_chat_format, op2_suffix_tree, op3_quality_rules, op4_bpe, op5_shard_table, op6_simhash, op7_fm_index,
        op8_token_files, op9_wrapper, op10_discriminant, op11_geometric_blocks, op12_merkle, op13_piece_merges)}


def oracle_sql() -> dict[str, str]:
    slots = ", ".join(f"'{s}'" for s in sharding.fill_table(SHARDS))
    shard_table = f"""
        WITH placed AS (
            SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {sharding.TABLE_SIZE} AS slot
            FROM documents)
        SELECT doc_id, slot::INTEGER AS slot, [{slots}][slot + 1] AS shard FROM placed"""
    return {"op1_chat_format": oracle.CHAT, "op3_quality_rules": oracle.QUALITY_RULES, "op5_shard_table": shard_table,
            "op7_fm_index": oracle.FM_INDEX, "op11_geometric_blocks": oracle.RANKED, "op12_merkle": oracle.MERKLE}
