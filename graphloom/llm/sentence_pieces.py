"""SentencePiece encoding and decoding by a distinct-chunk table.

SentencePiece marks white space with U+2581. Where no piece of a model holds that mark
behind another character, no piece can reach over the start of a marked word, so a text
is segmented by segmenting its marked words. Every distinct word of a slice of texts is
looked up once; those that the worker's table lacks are segmented once, in one call of
the library, and ids are joined back by position. The table is bounded; it is kept by
each worker instead of being shuffled and joined, because one row for each word of the
corpus would be several times the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import list_array, text_batches, text_slices
from .span_table import SpanTable, per_text

MARK = "▁"


def load_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def segments_by_words(model) -> bool:
    """Whether a text's ids are those of its marked words in turn: identity normaliser, dummy prefix, and no piece with a mark behind another character."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    norm = proto.normalizer_spec
    return (
        not norm.precompiled_charsmap
        and norm.add_dummy_prefix
        and not norm.remove_extra_whitespaces
        and norm.escape_whitespaces
        and not proto.trainer_spec.treat_whitespace_as_suffix
        and model.piece_to_id(MARK) != model.unk_id()
        and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces if p.type in (1, 4, 5))
        and not any(p.type == 4 and MARK in p.piece for p in proto.pieces)
    )


def marked_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): texts behind their first mark, and their marked words; marks are spaces here.

    A word starts at every mark that follows something else; further marks stay with the word behind them.
    """
    full = off[1:] > off[:-1]
    marked = np.insert(raw, off[:-1][full], 32)
    off = off + np.concatenate([[0], np.cumsum(full)])
    begin = marked == 32
    begin[1:] &= marked[:-1] != 32
    begin[off[:-1][full]] = True
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, off)
    ends = np.append(starts[1:], 0)
    ends[first[1:][full] - 1] = off[1:][full]
    return marked, starts, ends[: len(starts)], first


class Pieces:
    """A worker's model and table."""

    def __init__(self, path: str):
        self.model = load_model(path)
        self.whole = not segments_by_words(self.model)
        self.mark = [self.model.piece_to_id(MARK)]
        self.table = SpanTable(self.encode_words)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of marked words; the library adds the first mark itself, but not to an empty text."""
        found = self.model.encode([w[1:] for w in words], out_type=int, num_threads=1)
        return [i if len(w) > 1 else self.mark for w, i in zip(words, found)]

    def ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice, one after the other, and the number of each text's."""
        data = raw.tobytes()
        if self.whole:
            texts = [data[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            found = self.model.encode(texts, out_type=int, num_threads=1)
            return np.fromiter((i for f in found for i in f), np.int32), np.fromiter(map(len, found), np.int64, len(found))
        if MARK.encode() in data:  # a mark in the text is a space to the model
            texts = [data[a:b].replace(MARK.encode(), b" ") for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            raw, off = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        marked, starts, ends, first = marked_spans(raw, off)
        ids, lengths = self.table.resolve(marked, starts, ends)
        return ids, per_text(lengths, first)


_workers: dict[str, Pieces] = {}


def worker_pieces(path: str) -> Pieces:
    if path not in _workers:
        _workers[path] = Pieces(path)
    return _workers[path]


#: Lists of ids handed to the library's decode at once.
DECODED = 64


def _decoded(model, rows: list[list[int]]) -> list[str]:
    return [t for a in range(0, len(rows), DECODED) for t in model.decode(rows[a : a + DECODED], num_threads=1)]


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", keep_text: bool = True, decoded: str | None = None) -> DataFrame:
    """df with `ids`, the ids of each whole text as the library gives them (array of int), without begin or end ids.

    With `decoded`, a column of that name holds what the ids decode to, as `decode` gives it, made by the same worker,
    so that ids needn't go to a second one and back; it may be the text's own name. A null text is empty and has no ids.
    Rows are kept as they are, repeated ones too; columns named like results are replaced. A word of any length is
    segmented whole.
    """
    text_batches(df.sparkSession)
    columns = [c for c in df.columns if c == text or c not in (ids, decoded)]
    kept = [df.schema[c] for c in columns if c not in (ids, decoded) and (keep_text or c != text)]
    more = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType())), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(path)
        for batch in batches:
            for a, b, raw, off in text_slices(batch.column(batch.schema.get_field_index(text))):
                found, counts = pieces.ids(raw, off)
                arrays = [batch.column(batch.schema.get_field_index(f.name)).slice(a, b - a) for f in kept]
                lists = list_array(found, counts, pa.int32())
                texts = [pa.array(_decoded(pieces.model, lists.to_pylist()), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*arrays, lists, *texts], names=schema.names)

    return df.select(*columns).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded", keep_ids: bool = True) -> DataFrame:
    """df with `text`, what the library's decode gives for each whole list of ids.

    Null lists are empty and give an empty text; null ids within a list are left out. A column named
    like the result is replaced.
    """
    text_batches(df.sparkSession)
    columns = [c for c in df.columns if c != text]
    kept = [df.schema[c] for c in columns if keep_ids or c != ids]
    schema = T.StructType([*kept, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_pieces(path).model
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            out: list[str] = []
            for a in range(0, len(column), DECODED):
                out += _decoded(model, [[i for i in r or () if i is not None] for r in column.slice(a, DECODED).to_pylist()])
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(out, pa.string())], names=schema.names)

    return df.select(*columns).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text, encoded and decoded whole."""
    both = encode(df.select("doc_id", text), path, text, "ids", keep_text=False, decoded="decoded")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
