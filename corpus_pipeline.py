"""A corpus pipeline of five of the operators: each stage works on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_repeats, jaccard_join, line_quality, mixing, sentence_pieces
from graphloom.llm.common import cut, free_shuffles, read
from graphloom.llm.queries import PIECES, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content."""
    model = line_quality.fit(docs, read(spark, sf_dir, "labels"))
    return line_quality.rate(docs, model).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of similar ones; equal rows once. Rows without a doc_id stay.

    Rows of one doc_id with different texts are decided one by one, by their sets of shingles.
    """
    groups = jaccard_join.groups(docs.select("doc_id", "text"), keys=True)
    others = cut(groups.where("class_id <> doc_id").select("doc_id", "set_key").distinct(), "others")
    twice = cut(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "twice")
    if not twice.limit(1).count():
        return docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(twice, "doc_id", "left_anti").join(others, "doc_id", "left_anti").select(*docs.columns)
    more = jaccard_join.with_set_keys(docs.join(twice, "doc_id", "left_semi").select(*docs.columns))
    more = more.join(others, ["doc_id", "set_key"], "left_anti").select(*docs.columns)
    return once.unionByName(more.dropDuplicates(["doc_id", "text"]))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; a document that loses all its words goes."""
    out = exact_repeats.remove_repeats(docs)
    out = out.where("n_words = 0 OR n_removed < n_words").withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, so those that it doesn't take go."""
    sized = docs.withColumns({"mix_sources": F.array("source"), "mix_size": mixing.word_count("text")})
    mixed = mixing.mix(sized, "mix_sources", "mix_size").where("taken > 0")
    times = F.sequence(F.lit(1), (F.col("taken") / F.col("mix_size")).cast("int"))
    return mixed.withColumn("mix_copy", F.explode(times)).select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and as its text what they decode to."""
    out = sentence_pieces.encode(docs, vocabulary(PIECES), decoded="text")
    return out.select("doc_id", "text", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeats),
    ("mixing sources", mixture),
    ("SentencePiece encoding and decoding", pieces),
]

#: Neither the labels of the CRF nor the ids of the model are within SQL's reach; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
            free_shuffles(spark)
    return docs
