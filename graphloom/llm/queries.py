"""The queries opN_<name>, each over its whole table with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_repeats, jaccard_join, line_quality, mixing, sentence_pieces, sharding, token_files, vector_search, word_tokens
from .common import read

#: Vocabularies that op1, op5 and op8 name.
PIECES, WORDS = "piece_bpe_32k.model", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(PIECES))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return vector_search.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_quality.rate(docs, line_quality.fit(docs, read(spark, sf_dir, "labels")), keep_text=False)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return word_tokens.token_counts(docs, vocabulary(WORDS), limit=2048)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_exact_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_repeats.digests(read(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(WORDS))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.array("source").alias("sources"), mixing.word_count("text").alias("size"))
    return mixing.mix(sized).drop("sources")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digests(read(spark, sf_dir, "conversations"))


#: A limit that a small table splits at too.
FINE = 16 << 10


def sharding_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 with shards of at most FINE bytes."""
    return sharding.shard(read(spark, sf_dir, "documents").select("doc_id", "text"), limit=FINE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()} | {"sharding_fine": sharding_fine}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.ORACLE, "op3_vector_search": vector_search.ORACLE, "op7_exact_repeats": exact_repeats.ORACLE, "op9_mixing": mixing.ORACLE, "op10_chat_format": chat_format.ORACLE, "sharding_fine": sharding.oracle(FINE)}
