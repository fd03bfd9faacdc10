"""What the operators share: shared work folders, Arrow slices of texts, and hashing of words and windows."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes; words are the runs of everything else.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Bytes of text handled at once within an Arrow batch.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see. Only a local session without that setting gets a folder of its own; a cluster must name one.

    Files stay until the owner of that folder removes them, since the frames returned by operators read them.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("graphloom.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        base = tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("graphloom.checkpoint.dir", base)
    return f"{base.rstrip('/')}/graphloom-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut", **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of finished plans go: call it after a large shuffle whose result was cut. They go once their plan is collected, which takes two collections: of the plan, then of its references."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = 4 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES, so that a worker holds a few texts however long they are.

    Frames are run after the operator has returned, under the session's settings of that time, so this can't be taken
    back here. Where the caller has set the bound, it stays theirs.
    """
    if spark.conf.get(_BATCHES) == _default_batches(spark):
        spark.conf.set(_BATCHES, str(BATCH_BYTES))


def _default_batches(spark: SparkSession) -> str:
    now = spark.conf.get(_BATCHES)
    spark.conf.unset(_BATCHES)
    default = spark.conf.get(_BATCHES)
    if now != default:
        spark.conf.set(_BATCHES, now)
    return default


def text_bytes(df: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows and bytes of a text column, to size buckets by; one row comes to the driver."""
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    return int(rows), int(size)


def power_of_two(n: float, least: int = 1) -> int:
    k = least
    while k < n:
        k *= 2
    return k


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows with about `limit` bytes each."""
    if not len(column):
        return
    raw, off = string_buffers(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1))
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on the seed alone."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text (and one past the last) the index of its first word."""
    n = len(raw)
    word = ~_IS_SPACE[raw]
    before = np.zeros(n + 1, bool)  # a word may run on from the byte before
    before[1:] = word
    before[off[off <= n]] = False
    starts = np.flatnonzero(word & ~before[:-1])
    after = np.zeros(n + 1, bool)
    after[:-1] = word
    after[off] = False
    ends = np.flatnonzero(word & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


_KEYS = seeded(8, 11) | np.uint64(1)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Steps of a span that are hashed one after the other; longer spans are hashed piece by piece, and the pieces' hashes likewise.
STEPS = 8


def eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; zeros behind the end."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    return np.ndarray((len(raw) + 1,), "<u8", padded.data, strides=(1,))


def _short(at_place: np.ndarray, starts: np.ndarray, lengths: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Hashes of spans of at most STEPS * 8 bytes: each 8 bytes are mixed in under a key of their place, so no sum of bytes can cancel out."""
    h = mix64(lengths.astype(np.uint64) * key[0] + key[1])
    open_ = np.arange(len(starts))
    for k in range(STEPS):
        left = lengths[open_] - 8 * k
        if k:
            open_, left = open_[left > 0], left[left > 0]
        if not len(open_):
            break
        word = at_place[starts[open_] + 8 * k] & _MASKS[np.clip(left, 0, 8)]
        h[open_] = mix64((h[open_] ^ word) * key[2] + key[3])
    return h


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, 8 bytes at a step; different seeds give independent hashes."""
    key = mix64(_KEYS + np.uint64(seed)) | np.uint64(1)
    at_place = eights(raw)
    lengths = (ends - starts).astype(np.int64)
    whole = 8 * STEPS
    if not (lengths > whole).any():
        return _short(at_place, starts, lengths, key)
    out = np.zeros(len(starts), np.uint64)
    long_ = lengths > whole
    out[~long_] = _short(at_place, starts[~long_], lengths[~long_], key)
    # pieces of STEPS * 8 bytes, then groups of STEPS of their hashes, until one is left of each span
    size = lengths[long_]
    n = -(-size // whole)
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    values = _short(at_place, starts[long_][owner] + whole * place, np.minimum(whole, size[owner] - whole * place), key)
    done = np.zeros(len(n), np.uint64)
    span = np.arange(len(n))
    while len(n):
        begin = np.cumsum(n) - n
        one = n == 1
        done[span[one]] = values[begin[one]]
        span, n, begin = span[~one], n[~one], begin[~one]
        m = -(-n // STEPS)
        owner = np.repeat(np.arange(len(m)), m)
        first = begin[owner] + STEPS * (np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m))
        left = np.minimum(STEPS, (begin + n)[owner] - first)
        h = np.full(len(owner), key[4])
        for k in range(STEPS):
            some = left > k
            h[some] = mix64((h[some] ^ values[first[some] + k]) * key[5] + key[6])
        values, n = h, m
    out[long_] = mix64((done ^ size.astype(np.uint64)) * key[7])
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of `width` word hashes, over document borders too; the caller leaves those out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[k : k + n]
    return mix64(h)


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices at which a window of one text starts, and the text of each."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(len(text)) - begin[text] + first[:-1][text], text


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, of batches sorted by them; only one group is held at a time."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(c[a] for c in columns)
            if last is not None and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """(table, edges): runs of complete groups of rows with equal keys, of batches sorted by them, many groups at a time."""
    held: pa.Table | None = None

    def split(table: pa.Table) -> list[int]:
        change = np.ones(table.num_rows, bool)
        change[1:] = False
        for k in keys:
            c = table.column(k).to_numpy()
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change).tolist()

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        edges = split(table)
        held = table.slice(edges[-1])
        if len(edges) > 1:
            yield table.slice(0, edges[-1]).combine_chunks(), edges
    if held is not None and held.num_rows:
        yield held.combine_chunks(), [0, held.num_rows]
