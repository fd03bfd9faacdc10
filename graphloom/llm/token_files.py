"""Token ids as Parquet: list columns with dictionary encoding, delta encoding for ids and offsets, small pages with page indexes.

The files hold one row for each document in ascending doc_id order: doc_id, part,
local_start (ids before it in its part), n_tokens and tokens. Reading positions alone never
touches the tokens; a filter on doc_id reads the pages that can hold it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, shared_folder, text_batches, text_bytes, text_slices
from .word_tokens import worker_vocabulary

#: Bytes of text behind one file at most, on average.
FILE_BYTES = 64 << 20
#: Row groups and pages of the files. Version 2 pages write plain numbers as deltas; ids of a vocabulary go by dictionary.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("local_start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("tokens", T.ArrayType(T.IntegerType(), False)),
])


def write_token_ids(df: DataFrame, vocabulary_path: str, path: str, text: str = "text", end_id: int = 1, layout: dict[str, str] | None = None) -> str:
    """Write the ids of every whole text, each with end_id behind, in ascending doc_id order; returns path.

    One shuffle deals documents by ranges of (doc_id, hash of the text), so that even one doc_id with many
    rows is spread. Null texts are empty (the end id alone); null doc_ids come first; rows with the same
    doc_id are all written, in an order that depends on their texts alone. Other columns are left out.
    """
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_vocabulary(vocabulary_path)
        part = TaskContext.get().partitionId()
        before = 0
        for batch in batches:
            for a, b, raw, off in text_slices(batch.column(1)):
                ids, counts = vocabulary.ids(raw, off)
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(starts), pa.array(counts), list_array(ids, counts, pa.int32())], names=SCHEMA.names)

    rows = df.select(F.col("doc_id").cast("long"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    _, size = text_bytes(rows)
    files = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    dealt = rows.repartitionByRange(files, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    dealt.mapInArrow(run, SCHEMA).write.options(**(LAYOUT | (layout or {}))).parquet(path)
    return path


def read_token_ids(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "start", "n_tokens", "tokens"), where=None) -> DataFrame:
    """The documents of token files with `start`, the number of ids of all documents before; only the named columns are read.

    The number of ids of each part (one row for each file) comes to the driver and back as a broadcast.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted((r.part, r.n) for r in files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, before = [], 0
    for part, n in totals:
        bases.append((part, before))
        before += n
    base = spark.createDataFrame(bases, "part int, base long")
    rows = files if where is None else files.where(where)
    read = rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start"))
    return read.select(*columns)


def crc32_of_tokens(df: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each list of tokens as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(3)
            flat = column.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            off = column.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(flat)).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return df.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(df: DataFrame, vocabulary: str) -> DataFrame:
    """Write all documents' ids to the shared folder and give what the files hold of each."""
    spark = df.sparkSession
    path = write_token_ids(df, vocabulary, f"{shared_folder(spark)}/tokens")
    return crc32_of_tokens(read_token_ids(spark, path))
