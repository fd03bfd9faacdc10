"""Token counts, and the span table that they share with the binary output.

A text is split at ASCII white space, and a run of ASCII punctuation behind a letter is cut
off. Where a vocabulary's normaliser works character by character and its pre-tokeniser
drops white space, no token can span those places, so the ids of a text are those of its
spans in turn. `splits_at_spaces` checks that of a vocabulary; others are encoded text by
text.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, span_hashes, text_batches, text_slices, word_spans
from .span_table import KEPT_BYTES, SpanTable, per_text

#: Spans whose lengths are broadcast, and spans that each task reports to find them.
FREQUENT = 65_536
PER_TASK = 8_192

#: A fixed value: the only pre-token pattern whose pieces this module knows how to find.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker for each core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_at_spaces(path: str) -> bool:
    """Whether ids of a text are those of its chunks between spaces: lower-casing and NFC only, white space dropped, no token with white space."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def parts(x, key):
        return [] if x is None else [z for y in x[key] for z in parts(y, key)] if x["type"] == "Sequence" else [x]

    norm = parts(spec["normalizer"], "normalizers")
    pre = parts(spec["pre_tokenizer"], "pretokenizers")
    return (
        all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in norm)
        and bool(pre)
        and pre[0]["type"] == "Split"
        and pre[0]["behavior"] == "Removed"
        and pre[0]["invert"]
        and pre[0]["pattern"].get("Regex", "") == PATTERN
        and any(n["type"] == "Lowercase" for n in norm)
        and all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:])
        # special tokens are told by their `<`, and nothing is cut off behind their `>`
        and all(t["content"][:1] == "<" and t["content"][-1:] == ">" for t in spec["added_tokens"])
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        and spec["model"]["type"] == "BPE"
        and not spec["model"]["dropout"]
        and not spec.get("post_processor")
    )


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = _bytes(bytes(range(65, 91)))
_LETTER = _bytes(bytes(range(97, 123))) | _UPPER
#: Bytes of spans whose letters keep their case: of special tokens, which are looked for before anything is lowered, and of
#: letters beyond ASCII, since NFC comes before lower case (T with a diaeresis stays two characters, t doesn't).
_AS_IT_IS = _bytes(bytes([60, *range(128, 256)]))
#: ASCII punctuation but the apostrophe, which begins contractions, and what special tokens begin and end with.
_TAIL = _bytes(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'<>|"))
#: Letters that NFC leaves as they are; those that are capitals too are told apart by lower().
_LETTERS = re.compile("[a-zß-öø-įıĳ-ſ]+").fullmatch
#: Bytes of punctuation that are cut off at most; longer runs stay with their word.
TAIL_BYTES = 6


def spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): ASCII letters in lower case, and spans whose ids follow one another.

    The normaliser lowers letters anyway; spans with a `<` or with bytes beyond ASCII stay as they are. Punctuation is cut off only behind an ASCII letter or one of U+00C0 to U+00FF.
    """
    starts, ends, first = word_spans(raw, off)
    low = _LOWER[raw]
    upper = np.flatnonzero(_UPPER[raw])
    if len(starts) and len(upper):
        stays = np.zeros(len(starts), bool)
        stays[np.searchsorted(starts, np.flatnonzero(_AS_IT_IS[raw]), side="right") - 1] = True
        upper = upper[stays[np.searchsorted(starts, upper, side="right") - 1]]
        low[upper] = raw[upper]
    cut = ends.copy()
    open_ = np.arange(len(starts))
    for _ in range(TAIL_BYTES):
        open_ = open_[_TAIL[low[cut[open_] - 1]] & (cut[open_] - starts[open_] > 1)]
        cut[open_] -= 1
    before = low[cut - 1] if len(cut) else low[:0]
    second = low[np.maximum(cut - 2, 0)] == 0xC3  # U+00C0 to U+00FF but for the signs for times and divided
    second &= (cut - starts > 1) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    cut = np.where(_LETTER[before] & (cut > starts) | second, cut, ends)
    tails = cut < ends
    extra = np.cumsum(tails)
    place = np.arange(len(starts)) + extra - tails
    all_starts, all_ends = np.empty((2, len(starts) + int(tails.sum())), np.int64)
    all_starts[place], all_ends[place] = starts, cut
    all_starts[place[tails] + 1], all_ends[place[tails] + 1] = cut[tails], ends[tails]
    shift = np.concatenate([[0], extra])
    return low, all_starts, all_ends, first + shift[first]


class Vocabulary:
    """A worker's tokenizer and table."""

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.whole = not splits_at_spaces(path)
        self.table = SpanTable(self.encode)
        self.words = self.tokenizer if self.whole else self._without_normaliser(path)

    @staticmethod
    def _without_normaliser(path: str):
        """The same vocabulary and merges for words that are normalised and pre-tokenised already."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        levels = [p for p in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if p["type"] == "ByteLevel"]
        return Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": levels[0] if levels else None, "added_tokens": []}))

    def encode(self, texts: list[str]) -> list[list[int]]:
        plain = [k for k, t in enumerate(texts) if _LETTERS(t) and t == t.lower()] if not self.whole else []
        rest = sorted(set(range(len(texts))).difference(plain))
        out: list[list[int]] = [[]] * len(texts)
        for places, tokenizer in ((plain, self.words), (rest, self.tokenizer)):
            for k, e in zip(places, tokenizer.encode_batch_fast([texts[k] for k in places], add_special_tokens=False) if places else ()):
                out[k] = e.ids
        return out

    def ids(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a slice, one after the other, and the number of each text's."""
        if self.whole:
            data = raw.tobytes()
            found = self.encode([data[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist())])
            return np.fromiter((i for f in found for i in f), np.int32), np.fromiter(map(len, found), np.int64, len(found))
        low, starts, ends, first = spans(raw, off)
        ids, lengths = self.table.resolve(low, starts, ends)
        return ids, per_text(lengths, first)


_workers: dict[str, Vocabulary] = {}


def worker_vocabulary(path: str) -> Vocabulary:
    if path not in _workers:
        _workers[path] = Vocabulary(path)
    return _workers[path]


def frequent_spans(df: DataFrame, text: str = "text", keep: int = FREQUENT, per_task: int = PER_TASK) -> list[str]:
    """The spans found most often over all texts, by lossy counting: each task reports at most per_task counts, which are then summed.

    A task counts the spans that recur within a slice. Only spans that make up a share of 1 / (4 * keep) of all
    come to the driver, so there are at most 4 * keep however large the input; `keep` of them stay. They only
    decide which tier answers, never the result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        total = 0
        for batch in batches:
            for _, _, raw, off in text_slices(batch.column(0)):
                low, starts, ends, _ = spans(raw, off)
                total += len(starts)
                _, at, n = np.unique(span_hashes(low, starts, ends), return_index=True, return_counts=True)
                at, n = at[n > 1], n[n > 1]
                data = low.tobytes()
                seen.update({data[a:b].decode(): k for a, b, k in zip(starts[at].tolist(), ends[at].tolist(), n.tolist())})
                if len(seen) > 32 * per_task:
                    seen = Counter(dict(seen.most_common(8 * per_task)))
        top = [(k, n) for k, n in seen.most_common(per_task) if n * 4 * keep >= total] + [(None, total)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["span", "n"])

    counts = cut(df.select(text).mapInArrow(count, "span string, n long"), "spans")
    total = counts.where("span IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sums = counts.where("span IS NOT NULL").groupBy("span").agg(F.sum("n").alias("n")).where(F.col("n") * (4 * keep) >= total)
    return [r.span for r in sums.orderBy(F.desc("n"), "span").limit(keep).collect()]


class Lengths:
    """The first tier: the lengths of frequent spans, with their bytes, in about a MB."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray, lengths: np.ndarray):
        starts = np.append(np.zeros(1, np.int64), ends)[: len(ends)]
        hashes = np.maximum(span_hashes(raw, starts, ends), np.uint64(1))
        _, at = np.unique(hashes, return_index=True)
        self.table = SpanTable(lambda texts: [], max(1024, len(at)))
        self.table.add(raw, starts[at], ends[at], hashes[at], [[int(n)] for n in lengths[at]])

    def of(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The length of each span, -1 where the table doesn't have it."""
        found = self.table.find(np.maximum(hashes, np.uint64(1)))
        there = self.table.same(raw, starts, ends, found)
        return np.where(there, self.table.ids[np.where(there, found, 0)], -1)


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 2048, keep: int = FREQUENT) -> DataFrame:
    """df with n_bytes, n_tokens and over_limit of each whole text, without any shuffle of its spans.

    First tier: a broadcast table of at most `keep` frequent spans of at most KEPT_BYTES bytes, and their lengths.
    Second tier: spans missing there are encoded once for each worker, whose table is bounded.
    Null texts are empty (0 bytes, 0 tokens). Columns of df named like results are replaced; rows
    are kept as they are, repeated ones too. Very long texts are split, never cut.
    """
    spark = df.sparkSession
    text_batches(spark)
    driver = Vocabulary(path)
    words = [] if driver.whole else frequent_spans(df, text, keep)
    words = [w for w in words if len(w.encode()) <= KEPT_BYTES]
    lengths = np.array([len(i) for i in driver.encode(words)], np.int64)
    ends = np.cumsum([len(w.encode()) for w in words]).astype(np.int64)
    packed = spark.sparkContext.broadcast((np.frombuffer("".join(words).encode(), np.uint8), ends, lengths))
    kept = [c for c in df.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    fields = [df.schema[c] for c in kept if c != text]
    schema = T.StructType([*fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = worker_vocabulary(path)
        frequent = Lengths(*packed.value)
        for batch in batches:
            n_bytes, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, raw, off in text_slices(batch.column(batch.schema.get_field_index(text))):
                n_bytes.append(np.diff(off))
                if vocabulary.whole:
                    n_tokens.append(vocabulary.ids(raw, off)[1])
                    continue
                low, starts, ends, first = spans(raw, off)
                hashes = span_hashes(low, starts, ends)
                lengths = frequent.of(low, starts, ends, hashes)
                missed = lengths < 0
                lengths[missed] = vocabulary.table.resolve(low, starts[missed], ends[missed], hashes[missed], ids=False)[1]
                n_tokens.append(per_text(lengths, first))
            total = np.concatenate(n_tokens)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in fields]
            arrays += [pa.array(np.concatenate(n_bytes)), pa.array(total), pa.array(total > limit)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*kept).mapInArrow(count, schema)
