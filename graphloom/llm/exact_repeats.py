"""Removal of word sequences that an earlier document holds too, by fixed-block anchors.

Every run of 13 words holds a whole block of 7 words that starts at a multiple of 7 in its
document. Those blocks are the index; the 7 words from every position are the probes. Both
are hashed, and dealt to buckets by the first bits of the hash, packed: a row holds what a
slice of texts sends to one bucket, so rows, not entries, cost. A block whose hash another
document holds too, at any place, is a hit. Hits go back to their documents, where each is
extended to the 13-word windows that hold it; the smallest doc_id of each such window decides
which of the others go. Windows that overlap unite to maximal repeats, since each is judged
on the input.

A probe only says that a document holds its hash, so a slice of texts sends at most two for
each hash, those of its smallest and largest doc_id. Blocks whose hash two documents of their
slice hold are hits at once, and of a window that several of them hold all but the smallest
are later ones. So a passage in a third of all texts sends to its bucket a few entries of
each slice, however many texts hold it.

A 13-word window that starts in two documents holds a block of each, and each is probed by
the other, so no window is missed. Windows are compared by 96 bits of two independent
hashes of their words.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_shuffles, grouped, power_of_two, span_hashes, text_batches, text_bytes, text_slices, window_hashes, window_starts, word_spans

WINDOW = 13
#: Bytes of text behind one bucket (about a million probes), behind one group of documents, and of a slice.
BUCKET_BYTES = 8 << 20
GROUP_BYTES = 4 << 20
SLICE = 2 << 20
#: Tasks of a shuffle at most; with more buckets or groups than that a task takes several in turn.
TASKS = 20_000

_HEAD = struct.Struct("<II")
#: The position of a probe, which needs no answer.
NO_BLOCK = 0xFFFFFFFF
#: A probe's hash behind the bits that name its bucket, and a window's two hashes, 96 bits in all.
PROBE, PAIR = np.dtype("<u4"), np.dtype([("a", "<u8"), ("b", "<u4")])


def pack(doc: np.ndarray, key: np.ndarray, hashes: np.ndarray | None, pos: np.ndarray) -> bytes:
    """Entries whose equal rows stand together, as bytes: each row's doc_id and key once, then hashes and positions."""
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
    counts = np.diff(np.append(edge, len(doc)))
    body = [_HEAD.pack(len(edge), len(doc)), doc[edge].astype("<i8").tobytes(), key[edge].astype("<i8").tobytes(), counts.astype("<u4").tobytes(), pos.astype("<u4").tobytes()]
    if hashes is not None:
        body.append(hashes.tobytes())
    return zstandard.compress(b"".join(body), 1)


def unpack(blobs: list[bytes], kind: np.dtype | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """doc_id, key, hash (of type `kind`, if any) and position of all entries of packed rows."""
    doc, key, hashes, pos = [], [], [], []
    for blob in blobs:
        raw = zstandard.decompress(blob)
        d, n = _HEAD.unpack_from(raw)
        at = _HEAD.size
        ids = np.frombuffer(raw, "<i8", d, at)
        keys = np.frombuffer(raw, "<i8", d, at + 8 * d)
        counts = np.frombuffer(raw, "<u4", d, at + 16 * d)
        pos.append(np.frombuffer(raw, "<u4", n, at + 20 * d))
        doc.append(np.repeat(ids, counts))
        key.append(np.repeat(keys, counts))
        if kind:
            hashes.append(np.frombuffer(raw, kind, n, at + 20 * d + 4 * n))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(doc, np.int64), join(key, np.int64), join(hashes, kind) if kind else None, join(pos, np.uint32)


#: Rows dealt to a bucket; those with a group are marks on their way to it, which only pass through.
DEALT = T.StructType([T.StructField("to", T.LongType()), T.StructField("group", T.LongType()), T.StructField("payload", T.BinaryType())])
MARKS = T.StructType([T.StructField("group", T.LongType()), T.StructField("payload", T.BinaryType())])


def _blobs(to: np.ndarray, doc: np.ndarray, key: np.ndarray, hashes: np.ndarray | None, pos: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """(receivers, a packed row for each); entries of a row keep together."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    edges = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
    doc, key, pos = doc[order], key[order], pos[order]
    hashes = hashes[order] if hashes is not None else None
    blobs = [pack(doc[a:b], key[a:b], None if hashes is None else hashes[a:b], pos[a:b]) for a, b in zip(edges, np.append(edges[1:], len(to)))]
    return pa.array(to[edges].astype(np.int64)), pa.array(blobs, pa.binary())


def _to_buckets(to: np.ndarray, doc: np.ndarray, key: np.ndarray, hashes: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    to, blobs = _blobs(to, doc, key, hashes, pos)
    return pa.RecordBatch.from_arrays([to, pa.nulls(len(to), pa.int64()), blobs], names=DEALT.names)


def _marks(doc: np.ndarray, key: np.ndarray, pos: np.ndarray, groups: int) -> tuple[pa.Array, pa.Array]:
    order = np.lexsort((pos, key, doc))
    return _blobs(np.mod(key, groups)[order], doc[order], key[order], None, pos[order])


def _passing_marks(doc: np.ndarray, key: np.ndarray, pos: np.ndarray, groups: int) -> pa.RecordBatch:
    """Marks on the way to their group, among the rows of buckets: receivers of their own below zero."""
    group, blobs = _marks(doc, key, pos, groups)
    return pa.RecordBatch.from_arrays([pa.array(-1 - group.to_numpy()), group, blobs], names=DEALT.names)


def _runs(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Where runs of equal hashes begin, in this order."""
    h = h[order]
    return np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)


def _probe(width: int, block: int, bits: int, groups: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in text_slices(batch.column(2), SLICE):
                starts, ends, first = word_spans(raw, off)
                keys, ids = (batch.column(k).slice(a, b - a).to_numpy(zero_copy_only=False) for k in (0, 1))
                hashes = window_hashes(span_hashes(raw, starts, ends), block)
                at, text = window_starts(first, block)
                fits = np.diff(first)[text] >= width
                at, text = at[fits], text[fits]
                if not len(at):
                    continue
                h, doc, key, pos = hashes[at], ids[text], keys[text], at - first[:-1][text]
                here, blocks, probes = _decided(h, doc, pos % block == 0)
                if here.any():
                    yield _passing_marks(doc[here], key[here], pos[here], groups)
                some = blocks | probes
                pos = np.where(blocks, pos, NO_BLOCK)[some]
                h, doc, key = h[some], doc[some], key[some]
                to = (h >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64) if bits else np.zeros(len(h), np.uint16)
                yield _to_buckets(to, doc, key, h.astype(PROBE), pos)

    return run


def _decided(h: np.ndarray, doc: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(blocks whose hash two documents of this slice hold; the other blocks; the probes that stand for each hash, but where a block does)."""
    order = np.argsort(h)
    edges = _runs(h, order)
    d, is_block = doc[order], block[order]
    low, high = np.minimum.reduceat(d, edges), np.maximum.reduceat(d, edges)
    sizes = np.diff(np.append(edges, len(h)))
    several, open_ = low != high, ~np.logical_or.reduceat(is_block, edges)
    here, probes = np.zeros(len(h), bool), np.zeros(len(h), bool)
    here[order] = is_block & np.repeat(several, sizes)
    probes[order[edges[open_ & ~several]]] = True
    run = np.repeat(np.arange(len(edges)), sizes)
    inside = np.flatnonzero(several[run])
    for end in (low, high):
        chosen = inside[d[inside] == end[run[inside]]]
        probes[order[chosen[np.unique(run[chosen], return_index=True)[1]]]] = True
    return here, block & ~here, probes


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table | pa.RecordBatch]:
    """Whole buckets, and the marks that pass through."""
    for table in grouped(batches, ["to"]):
        if table.column("to")[0].as_py() < 0:
            yield from table.select(["group", "payload"]).to_batches()
        else:
            yield table


def _hits(groups: int) -> Callable:
    """Of each bucket, the blocks whose hash another doc_id holds too; dealt to groups of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tables(batches):
            if isinstance(rows, pa.RecordBatch):
                yield rows
                continue
            doc, key, h, pos = unpack(rows.column("payload").to_pylist(), PROBE)
            order = np.argsort(h)
            edges = _runs(h, order)
            d = doc[order]
            shared = np.minimum.reduceat(d, edges) != np.maximum.reduceat(d, edges)
            good = order[np.repeat(shared, np.diff(np.append(edges, len(d)))) & (pos[order] != NO_BLOCK)]
            if len(good):
                yield pa.RecordBatch.from_arrays([*_marks(doc[good], key[good], pos[good], groups)], names=MARKS.names)

    return run


def _earliest(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each window, whether no smaller doc_id among these has it."""
    order = np.lexsort((h["b"], h["a"]))
    edges = _runs(h, order)
    out = np.zeros(len(h), bool)
    if len(h):
        out[order] = doc[order] == np.repeat(np.minimum.reduceat(doc[order], edges), np.diff(np.append(edges, len(h))))
    return out


def _later(groups: int) -> Callable:
    """Of each bucket, the windows that a smaller doc_id holds too; dealt to groups of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _tables(batches):
            if isinstance(rows, pa.RecordBatch):
                yield rows
                continue
            doc, key, h, pos = unpack(rows.column("payload").to_pylist(), PAIR)
            later = ~_earliest(h, doc)
            if later.any():
                yield pa.RecordBatch.from_arrays([*_marks(doc[later], key[later], pos[later], groups)], names=MARKS.names)

    return run


def _to_hash_buckets(dealt: DataFrame, buckets: int) -> DataFrame:
    return dealt.repartition(min(buckets, TASKS), "to").sortWithinPartitions("to")


def _by_group(docs: DataFrame, marks: DataFrame, groups: int) -> DataFrame:
    """Rows of documents (kind 1) and, before them, what was dealt to their group (kind 0)."""
    left = docs.select(F.pmod("key", F.lit(groups)).cast("long").alias("group"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("payload"), *docs.columns)
    right = marks.select("group", F.lit(0).alias("kind"), "payload", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    return left.unionByName(right).repartition(min(groups, TASKS), "group").sortWithinPartitions("group", "kind")


class _Marks:
    """Positions dealt to a group of documents, by row."""

    def __init__(self, blobs: list[bytes]):
        doc, key, _, pos = unpack(blobs, None)
        order = np.lexsort((key, doc))
        doc, key, self.pos = doc[order], key[order], pos[order].astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])).tolist() if len(doc) else []
        self.at = {(int(doc[a]), int(key[a])): (a, b) for a, b in zip(edges, [*edges[1:], len(doc)])}

    def of(self, ids: list, keys: list, first: np.ndarray, n: int) -> np.ndarray:
        """A flag for each word index of a slice."""
        out = np.zeros(n, bool)
        for d, k, f in zip(ids, keys, first.tolist()):
            if (at := self.at.get((d, k))) is not None:
                out[f + self.pos[at[0] : at[1]]] = True
        return out


def _with_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Marks, pa.RecordBatch]]:
    """Rows of documents with the marks of their group; of one group at a time."""
    group, blobs, marks = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        to = batch.column(0).to_numpy()
        kind = batch.column(1).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (to[1:] != to[:-1]) | (kind[1:] != kind[:-1]), [True]])).tolist()
        for a, b in zip(edges[:-1], edges[1:]):
            if to[a] != group:
                group, blobs, marks = to[a], [], None
            rows = batch.slice(a, b - a)
            if kind[a] == 0:
                blobs += rows.column(2).to_pylist()
                continue
            if marks is None:
                marks, blobs = _Marks(blobs), []
            yield marks, rows


def _extend(width: int, block: int, bits: int, groups: int) -> Callable:
    """Hashes of the windows of `width` words that hold a hit, dealt to buckets; those that a smaller doc_id of this slice has are later ones already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, rows in _with_marks(batches):
            if not marks.at:
                continue
            for a, b, raw, off in text_slices(rows.column(5), SLICE):
                starts, ends, first = word_spans(raw, off)
                keys, ids = (rows.column(k).slice(a, b - a).to_numpy(zero_copy_only=False) for k in (3, 4))
                hit = np.zeros(len(starts) + 1, np.int64)
                np.cumsum(marks.of(ids.tolist(), keys.tolist(), first, len(starts)), out=hit[1:])
                at, text = window_starts(first, width)
                holds = hit[at + width - block + 1] > hit[at]
                at, text = at[holds], text[holds]
                if not len(at):
                    continue
                h = np.empty(len(at), PAIR)
                h["a"] = window_hashes(span_hashes(raw, starts, ends), width)[at]
                h["b"] = window_hashes(span_hashes(raw, starts, ends, 1), width)[at] >> np.uint64(32)
                doc, key, pos = ids[text], keys[text], at - first[:-1][text]
                mine = _earliest(h, doc)
                if not mine.all():
                    yield _passing_marks(doc[~mine], key[~mine], pos[~mine], groups)
                to = (h["a"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
                yield _to_buckets(to[mine], doc[mine], key[mine], h[mine], pos[mine])

    return run


def _without(raw: bytes, spans: list[tuple[int, int]], gone: np.ndarray, separators: bool) -> bytes:
    """The words that stay: joined by one space, or with the white space that stood before each."""
    if not separators:
        return b" ".join([raw[a:b] for (a, b), g in zip(spans, gone.tolist()) if not g])
    out, before = [], 0
    for (a, b), g in zip(spans, gone.tolist()):
        if not g:
            out += [raw[before:a] if out else b"", raw[a:b]]
        before = b
    return b"".join(out)


def remove_repeats(df: DataFrame, text: str = "text", width: int = WINDOW, separators: bool = True, spans: bool = False) -> DataFrame:
    """df with n_words and n_removed, and the text without every word covered by a window of `width` words whose sequence also starts in a row with a smaller doc_id.

    Words are runs of anything but ASCII white space, unchanged; windows are judged on the input. With
    `separators` a text that loses nothing stays as it is, and kept words of others keep the white space before
    them; else all texts become their kept words joined by one space. With `spans`, `repeats` lists the maximal
    repeats that were removed, as [start, end) word numbers. Null texts have no words and become empty
    without `separators`. Rows with a null doc_id are neither earlier nor later than others and stay whole. Rows
    with the same doc_id don't count as earlier than each other; each is judged by its own text. Columns named
    like results are replaced. doc_id must be a whole number; other columns are kept, their types too.
    """
    spark = df.sparkSession
    text_batches(spark)
    block = (width + 1) // 2
    others = [c for c in df.columns if c not in ("doc_id", text, "n_words", "n_removed", *(["repeats"] if spans else []))]
    docs = df.select(F.col("doc_id").cast("long"), F.col(text).alias("text"), *([F.struct(*others).alias("others")] if others else []))
    docs = docs.select(F.xxhash64("doc_id", "text").alias("key"), *docs.columns)  # tells rows of one doc_id apart
    known = docs.select("key", "doc_id", "text").where(F.col("doc_id").isNotNull())
    _, size = text_bytes(docs)
    bits = power_of_two(size / BUCKET_BYTES).bit_length() - 1
    groups = 2 * int(size / GROUP_BYTES / 2) + 1

    hits = cut(_to_hash_buckets(known.mapInArrow(_probe(width, block, bits, groups), DEALT), 1 << bits).mapInArrow(_hits(groups), MARKS), "hits")
    free_shuffles(spark)
    later = cut(_to_hash_buckets(_by_group(known, hits, groups).mapInArrow(_extend(width, block, bits, groups), DEALT), 1 << bits).mapInArrow(_later(groups), MARKS), "later")
    free_shuffles(spark)

    more = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    if spans:
        more.append(T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))))
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text"], *([docs.schema["others"]] if others else []), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for marks, rows in _with_marks(batches):
            column = rows.column(5)
            for a, b, raw, off in text_slices(column):
                starts, ends, first = word_spans(raw, off)
                keys, ids = (rows.column(k).slice(a, b - a).to_pylist() for k in (3, 4))
                begin = marks.of(ids, keys, first, len(starts)).astype(np.int64)
                runs = np.cumsum(begin)
                runs[width:] -= runs[:-width].copy()  # windows that start in the last `width` words
                gone = runs > 0
                lost = np.concatenate([[0], np.cumsum(gone)])
                removed = lost[first[1:]] - lost[first[:-1]]
                texts, found = [], []
                for k, t in enumerate(column.slice(a, b - a).to_pylist()):
                    low, high, o = first[k], first[k + 1], off[k]
                    if removed[k]:
                        t = _without(t.encode(), list(zip((starts[low:high] - o).tolist(), (ends[low:high] - o).tolist())), gone[low:high], separators).decode()
                    elif not separators:
                        t = b" ".join((t or "").encode().split()).decode()
                    texts.append(t)
                    if spans:
                        turns = np.flatnonzero(np.diff(np.concatenate([[False], gone[low:high], [False]]))).tolist()
                        found.append([{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2])])
                extra = [rows.column(6).slice(a, b - a)] if others else []
                arrays = [rows.column(4).slice(a, b - a), pa.array(texts, pa.string()), *extra, pa.array(np.diff(first)), pa.array(removed)]
                arrays += [pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))] if spans else []
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    out = _by_group(docs, later, groups).mapInArrow(run, schema)
    columns = {"doc_id": F.col("doc_id"), text: F.col("text").alias(text)} | {c: F.col("others").getField(c).alias(c) for c in others}
    return out.select(*[columns[c] for c in df.columns if c in columns], *[f.name for f in more])


def digests(df: DataFrame) -> DataFrame:
    out = remove_repeats(df.select("doc_id", "text"), separators=False)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Windows as joined words, so that other engines need no hashes of ours.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, i AS pos, array_to_string(words[i:i + 12], ' ') AS seq FROM w, unnest(range(1, len(words) - 11)) AS r(i)),
m AS (SELECT seq, min(doc_id) AS first FROM g GROUP BY seq),
c AS (SELECT DISTINCT g.doc_id, k AS pos FROM g JOIN m USING (seq), unnest(range(g.pos, g.pos + 13)) AS r(k) WHERE g.doc_id > m.first),
p AS (SELECT doc_id, k AS pos, words[k] AS word FROM w, unnest(range(1, len(words) + 1)) AS r(k)),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS kept, count(*) AS n FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.pos = c.pos GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
