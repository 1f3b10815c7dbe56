"""One query per operator over its whole table, with production parameters, and its SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipscore.llm import (
    bpe, conversation_trie, hnsw, langid, mixing, secret_scan, sharding, simhash, substring_dedup, suffix_dedup, syncmers, vector_codes, warc,
)
from clipscore.llm.common import table

MIX_WEIGHTS = {f"src{i}": 1.0 for i in range(20)}
SHARD_BYTES = 1 << 20

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_syncmer_fingerprints")
def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@query("op2_hnsw_neighbours")
def op2_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


@query("op4_simhash_groups")
def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), *bpe.public_vocabulary()).drop("ids")


@query("op6_poisson_mix", mixing.mix_sql(MIX_WEIGHTS, other=1.0))
def op6_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty sources and the rest at equal weight; the share of a group without text goes to none, as in the SQL."""
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, other=1.0)


@query("op7_secret_spans")
def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op9_substring_dedup")
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_words(table(spark, sf_dir, "documents")).drop("kept")


@query("op10_extendible_shards", sharding.shard_sql(SHARD_BYTES))
def op10_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most a mebibyte, small enough that the smallest tables split too."""
    return sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)


@query("op11_warc_archive", warc.archive_sql())
def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


@query("op12_conversation_trie", conversation_trie.trie_sql())
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(table(spark, sf_dir, "conversations"))


@query("op13_vector_codes", vector_codes.compress_sql())
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))
