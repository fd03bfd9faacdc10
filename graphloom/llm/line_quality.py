"""Quality rules: counts of each text, and a linear-chain CRF that marks its lines as content or boilerplate.

The CRF has two labels. A line's score as boilerplate is linear in a few shares of its
characters and words, in its share of the text, in whether it repeats an earlier line, and in whether many texts of the
corpus hold it while most of its own text is not shared; a 2 x 2 table scores neighbouring
labels. It is trained here, by gradient ascent on the conditional likelihood. Lines of a text
that is labelled bad are boilerplate, and so are lines of a good one that many texts share;
its other lines are content. So labels change within texts, and the table is learnt from
where they do. Viterbi decoding finds the best labels of all lines of a text; a text is kept
if at least half of its words stand in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, cut, mix64, span_hashes, text_batches, text_slices, window_hashes, window_starts, word_spans
from .sharding import hash_bits

#: Labelled documents to train on, at most, with all their lines; a longer text is trained on as sequences of so many lines.
SAMPLE_DOCUMENTS = 2000
SEQUENCE = 128
#: A line is shared if it makes up this share of the corpus's lines (so there are at most as many of them), and is there so often.
SHARED = 65_536
LEAST_SHARED = 5
#: Words of a repeated window, and the bounds of the base rules.
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
CONTENT_SHARE = 0.5

SYMBOLS = b"#*$%&|<>"
FEATURES = ("bias", "symbols", "capitals", "exclamations", "digits", "repeats an earlier line", "few words", "word length", "share of the text's words", "many texts share it")


def _class(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _LETTER = _class(range(65, 91)), _class([*range(65, 91), *range(97, 123)])
_DIGIT, _BANG, _SYMBOL = _class(range(48, 58)), _class(b"!"), _class(SYMBOLS)
_FIRST_IN_WORD = ~_class([*range(0x80, 0xC0), *SPACES])


@dataclass
class Model:
    """Weights of a boilerplate line's features, and scores of (label, next label); label 1 is boilerplate."""

    weights: np.ndarray
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    shared: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of shared lines


#: Used where there are no labels of both kinds: only lines full of symbols, or of shouting, are boilerplate.
PRIOR = Model(np.array([-4.0, 6.0, 5.0, 3.0, 4.0, 1.0, 0.0, 0.0, 0.0, 3.0]), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it is there twice or more, and whether it is there before."""
    order = np.argsort(keys, kind="stable")
    equal = keys[order][1:] == keys[order][:-1]
    before, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    before[order[1:]] = equal
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    return twice, before


@dataclass
class Counts:
    """Counts of each text of a slice, and the features of its lines with a word."""

    words: np.ndarray
    chars: np.ndarray
    symbols: np.ndarray
    repeated_lines: np.ndarray
    repeated_words: np.ndarray
    lines: np.ndarray  # number of lines with a word
    line_words: np.ndarray
    features: np.ndarray


@dataclass
class Lines:
    """The lines with a word of the texts of a slice: places, text, number of words and hash."""

    begin: np.ndarray
    stop: np.ndarray
    owner: np.ndarray
    words: np.ndarray
    hashes: np.ndarray


def lines_of(raw: np.ndarray, off: np.ndarray, starts: np.ndarray, first: np.ndarray) -> Lines:
    feed = np.flatnonzero(raw == 10)
    begin = np.unique(np.concatenate([off[:-1][np.diff(first) > 0], feed + 1]))
    begin = begin[begin < len(raw)]
    stop = np.concatenate([begin[1:], [len(raw)]]) if len(begin) else begin
    owner = np.searchsorted(off, begin, side="right") - 1
    stop = np.minimum(stop, off[owner + 1])
    stop = stop - ((stop > begin) & (raw[np.maximum(stop - 1, 0)] == 10))  # the line feed is no part of its line
    low, high = np.searchsorted(starts, begin), np.searchsorted(starts, stop)
    real = high > low
    begin, stop, owner, words = begin[real], stop[real], owner[real], (high - low)[real]
    return Lines(begin, stop, owner, words, span_hashes(raw, begin, stop))


def count(raw: np.ndarray, off: np.ndarray, shared: np.ndarray = np.zeros(0, np.uint64)) -> Counts:
    """Counts by array operations over all texts of a slice; windows and lines are compared by 64-bit hashes."""
    starts, ends, first = word_spans(raw, off)
    hashes = span_hashes(raw, starts, ends)
    n_words = np.diff(first)
    at, text = window_starts(first, WINDOW)
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(at):
        twice, _ = _repeated(window_hashes(hashes, WINDOW)[at] ^ mix64(text.astype(np.uint64) + np.uint64(1)))
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    inside = _sums(np.cumsum(covered)[: len(starts)] > 0)

    found = lines_of(raw, off, starts, first)
    begin, stop, owner, words = found.begin, found.stop, found.owner, found.words
    _, before = _repeated(found.hashes ^ mix64(owner.astype(np.uint64) + np.uint64(1)))
    many = shared[np.minimum(np.searchsorted(shared, found.hashes), len(shared) - 1)] == found.hashes if len(shared) else np.zeros(len(begin), bool)
    many &= 2 * np.bincount(owner[many], weights=words[many], minlength=len(n_words))[owner] < n_words[owner]  # a copy shares all its lines

    of = lambda table: (lambda s: s[stop] - s[begin])(_sums(table[raw]))
    length = np.maximum(stop - begin, 1)
    x = np.stack([
        np.ones(len(begin)),
        np.minimum(10 * of(_SYMBOL) / length, 2),
        of(_UPPER) / np.maximum(of(_LETTER), 1),
        np.minimum(of(_BANG) / np.maximum(words, 1), 2),
        of(_DIGIT) / length,
        before.astype(float),
        (words < 3).astype(float),
        np.minimum(length / np.maximum(words, 1) / 10, 3),
        words / np.maximum(n_words[owner], 1),
        many.astype(float),
    ], axis=1)
    texts = len(off) - 1
    per_text = lambda table: (lambda s: s[off[1:]] - s[off[:-1]])(_sums(table[raw]))
    return Counts(n_words, per_text(_FIRST_IN_WORD), per_text(_SYMBOL), np.bincount(owner[before], minlength=texts), inside[first[1:]] - inside[first[:-1]], np.bincount(owner, minlength=texts), words, x)


def viterbi(model: Model, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The best label of each line of sequences that follow one another; ties go to content."""
    scores = features @ model.weights
    labels = np.zeros(len(scores), np.int8)
    ends = np.cumsum(lines)
    begins = ends - lines
    order = np.argsort(-lines, kind="stable")  # at each place only the sequences that reach it
    sorted_lines = lines[order]
    if not len(scores):
        return labels
    best = np.zeros((len(scores), 2))
    back = np.zeros((len(scores), 2), np.int8)
    for k in range(int(sorted_lines[0])):
        at = begins[order[: np.searchsorted(-sorted_lines, -k, side="left")]] + k
        best[at, 1] = scores[at]
        if k:
            for y in (0, 1):
                from_0, from_1 = best[at - 1, 0] + model.steps[0, y], best[at - 1, 1] + model.steps[1, y]
                back[at, y] = from_1 > from_0
                best[at, y] += np.maximum(from_0, from_1)
    last = ends[lines > 0] - 1
    labels[last] = best[last, 1] > best[last, 0]
    for k in range(int(sorted_lines[0]) - 1, 0, -1):
        at = begins[order[: np.searchsorted(-sorted_lines, -k, side="left")]] + k
        labels[at - 1] = back[at, labels[at]]
    return labels


def likelihood(weights: np.ndarray, steps: np.ndarray, features: np.ndarray, lines: np.ndarray, gold: np.ndarray, share: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(sum of the sequences' log likelihoods of their gold labels, weighed by share, and its gradients by weights and steps), by forward and backward sums.

    Sequences have a line at least and follow one another, the longest first, so that those that reach a place come before the others.
    """
    begins = np.cumsum(lines) - lines
    emit = np.zeros((len(gold), 2))
    emit[:, 1] = features @ weights
    ahead, behind = emit.copy(), np.zeros_like(emit)
    at_place = [begins[: np.searchsorted(-lines, -k, side="left")] + k for k in range(int(lines[0]))]
    for at in at_place[1:]:
        ahead[at] += np.logaddexp(ahead[at - 1, 0, None] + steps[0], ahead[at - 1, 1, None] + steps[1])
    for at in at_place[:0:-1]:
        nxt = emit[at] + behind[at]
        behind[at - 1] = np.logaddexp(steps[:, 0] + nxt[:, 0, None], steps[:, 1] + nxt[:, 1, None])
    last = ahead[begins + lines - 1]
    norm = np.logaddexp(last[:, 0], last[:, 1])
    of = np.repeat(np.arange(len(lines)), lines)
    p1 = np.exp(ahead[:, 1] + behind[:, 1] - norm[of])
    follows = np.ones(len(gold), bool)
    follows[begins] = False
    b = np.flatnonzero(follows)
    joint = np.exp(ahead[b - 1, :, None] + steps + (emit + behind)[b, None, :] - norm[of[b], None, None])
    expected = (joint * share[of[b], None, None]).sum(axis=0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[b - 1], gold[b]), share[of[b]])
    value = share[of] @ emit[np.arange(len(gold)), gold] + (seen * steps).sum() - share @ norm
    return float(value), features.T @ (share[of] * (gold - p1)), seen - expected


def train(features: np.ndarray, lines: np.ndarray, gold: np.ndarray, bad: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Fit to texts (numbers of lines, labels of the lines, whether the text is bad) by gradient ascent from the prior with steps scaled by the gradients so far (Adam).

    Good texts weigh 0.7 in all, so that losing one costs more; each of a kind weighs the same, however long.
    """
    texts = lines > 0
    if bad[texts].all() or not bad[texts].any():
        return PRIOR
    share = np.where(bad, 0.3 / (bad & texts).sum(), 0.7 / (~bad & texts).sum()) / np.maximum(lines, 1)
    # sequences of at most SEQUENCE lines, the longest first
    pieces = -(-lines // SEQUENCE)
    of = np.repeat(np.arange(len(lines)), pieces)
    place = SEQUENCE * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    sizes = np.minimum(SEQUENCE, lines[of] - place)
    order = np.argsort(-sizes, kind="stable")
    begin = ((np.cumsum(lines) - lines)[of] + place)[order]
    of, sizes = of[order], sizes[order]
    rows = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    x, y, by_piece = features[rows], gold[rows], share[of]
    w, t = PRIOR.weights.copy(), PRIOR.steps.copy()
    moments = [np.zeros(len(w) + 4), np.zeros(len(w) + 4)]
    for r in range(1, rounds + 1):
        _, by_weights, by_steps = likelihood(w, t, x, sizes, y, by_piece)
        gradient = np.concatenate([by_weights - decay * w, (by_steps - 10 * decay * t).ravel()])
        moments = [0.9 * moments[0] + 0.1 * gradient, 0.99 * moments[1] + 0.01 * gradient**2]
        step = rate * (moments[0] / (1 - 0.9**r)) / (np.sqrt(moments[1] / (1 - 0.99**r)) + 1e-8)
        w, t = w + step[:-4], t + step[-4:].reshape(2, 2)
    return Model(w, t)


def shared_lines(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Sorted hashes of the lines that many texts hold, counted over all texts, once in each; at most SHARED of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, off in text_slices(batch.column(0)):
                starts, _, first = word_spans(raw, off)
                lines = lines_of(raw, off, starts, first)
                _, before = _repeated(lines.hashes ^ mix64(lines.owner.astype(np.uint64) + np.uint64(1)))
                hashes, n = np.unique(lines.hashes[~before], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["line", "n"])

    counts = cut(docs.select(text).mapInArrow(run, "line long, n long").groupBy("line").agg(F.sum("n").alias("n")), "lines")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counts.where(F.col("n") >= max(LEAST_SHARED, total / SHARED)).select("line").collect()
    return np.sort(np.array([r.line for r in often], np.int64).view(np.uint64))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", documents: int = SAMPLE_DOCUMENTS) -> Model:
    """A model of at most `documents` labelled rows, those of the smallest hashes of doc_id, with all their lines; shared lines are counted over all of docs.

    Labels that are null, labels of unknown documents, and texts that the base rules reject take no part. Without both kinds the prior is used.
    """
    text_batches(docs.sparkSession)
    shared = shared_lines(docs, text)
    order = hash_bits("doc_id", seed="quality")
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    chosen = chosen.orderBy(order, "doc_id", "quality").limit(documents)
    sample = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, off in text_slices(batch.column(1)):
                c = count(raw, off, shared)
                rows = np.split(c.features.astype(np.float32), np.cumsum(c.lines)[:-1])
                x = [b"" if f else r.tobytes() for r, f in zip(rows, _failed(c).tolist())]  # what the base rules reject needs no verdict
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(x, pa.binary())], names=["doc_id", "quality", "x"])

    quality = T.StructField("quality", labels.schema["quality"].dataType)
    rows = sample.select("doc_id", text, "quality").mapInArrow(run, T.StructType([docs.schema["doc_id"], quality, T.StructField("x", T.BinaryType())]))
    rows = rows.where(F.length("x") > 0).orderBy(order, "doc_id", "quality", "x").limit(documents).collect()  # doc_ids may repeat
    if not rows:
        return Model(PRIOR.weights, PRIOR.steps, shared)
    found = [np.frombuffer(r.x, np.float32).reshape(-1, len(FEATURES)) for r in rows]
    lines, bad, features = np.array([len(x) for x in found]), np.array([not r.quality for r in rows]), np.concatenate(found).astype(np.float64)
    gold = (np.repeat(bad, lines) | (features[:, -1] > 0)).astype(np.int64)
    model = train(features, lines, gold, bad)
    return Model(model.weights, model.steps, shared)


def _failed(c: Counts) -> np.ndarray:
    """The base rules."""
    return (c.words < LEAST_WORDS) | (100 * c.repeated_words > MOST_REPEATED * c.words)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_content_words", "base_failed", "kept")


def rate(df: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with COLUMNS of each whole text; columns of those names are replaced.

    Words are runs of anything but ASCII white space. A null or empty text has no words, so it fails the
    base rules. Rows are rated one by one, repeated ones alike; a text of any length is read whole.
    """
    text_batches(df.sparkSession)
    kept = [f for f in df.schema if f.name not in COLUMNS]
    out = [f for f in kept if keep_text or f.name != text]
    kinds = [T.LongType()] * 6 + [T.BooleanType()] * 2
    schema = T.StructType([*out, *[T.StructField(n, k) for n, k in zip(COLUMNS, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[np.ndarray]] = [[] for _ in COLUMNS]
            for _, _, raw, off in text_slices(batch.column(batch.schema.get_field_index(text))):
                c = count(raw, off, model.shared)
                labels = viterbi(model, c.features, c.lines)
                owner = np.repeat(np.arange(len(c.lines)), c.lines)
                content = np.bincount(owner, weights=c.line_words * (labels == 0), minlength=len(c.lines)).astype(np.int64)
                failed = _failed(c)
                good = ~failed & (content >= CONTENT_SHARE * c.words)
                for column, x in zip(found, (c.words, c.chars, c.symbols, c.repeated_lines, c.repeated_words, content, failed, good)):
                    column.append(x)
            arrays = [batch.column(batch.schema.get_field_index(f.name)) for f in out]
            arrays += [pa.array(np.concatenate(x) if x else [], pa.bool_() if k == T.BooleanType() else pa.int64()) for x, k in zip(found, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*[f.name for f in kept]).mapInArrow(run, schema)
