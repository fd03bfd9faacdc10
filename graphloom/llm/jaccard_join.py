"""N-gram Jaccard join by chosen paths.

A text's set is that of its five-word shingles. Equal sets are one class, and each class
is joined once. Sets are embedded by 96 min-hashes, which behave as 96 shared tokens: two
sets share each with a probability equal to their similarity. A run starts with all classes
that share one token in a node. A node that is too large picks one or two further tokens by
its own hash, so that similar sets choose the same paths, and passes each class on to the
child of each picked token: thirty-three tokens for twenty nodes, so that two sets at the bound share
more than one child on average and some common path lives on however deep it goes. A node is
a leaf when it is small, or when three picks would all give children that together ask for
nearly as many comparisons as itself, judged by a few hundred of its sets: then most of its sets are alike and have to be
compared anyway.

Classes that share a leaf are compared by brute force, first by a byte of each min-hash,
then, if those leave the bound in reach, by their shingles. Runs are repeated until pairs at
the bound meet with the recall asked for; after the first few only for classes whose nodes
were split, since a pair that shares a node that wasn't has met. A pair is compared in the smallest leaf that it
shares and nowhere else, so links are counted, never listed, and big leaves go to pairs of
blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_shuffles, mix64, seeded, span_hashes, text_batches, text_slices, whole_groups, window_hashes, word_spans
from .components import components

SHINGLE = 5
LEAST = 0.8
RECALL = 0.999
#: Min-hashes of a set; those of one level of a path, so that no path picks one twice; and the levels that this gives.
TOKENS = 96
CHOICE = 8
LEVELS = TOKENS // CHOICE
#: Share of nodes with two children, and the share of a node's comparisons that its children may ask for.
TWINS = 0.65
PAYS = 0.75
#: Levels at which a node may split; if none of them pays it is a leaf.
TRIES = 3
#: A leaf's size up to which it isn't split, and the rows of a block of a bigger leaf.
LEAF = 256
BLOCK = 384
#: Shingles of the sets whose intersections are counted at once.
TILE = 1 << 20


def _miss(s: float) -> float:
    """The chance that two sets that share each token with probability s meet in no leaf of a run, however deep its paths go."""
    gone = 0.0
    for _ in range(1000):
        one = 1 - s + s * gone
        gone = (1 - TWINS) * one + TWINS * one * one
    return 1 - s + s * gone


def _shared(least: float, tokens: int) -> list[float]:
    """The chances that a pair at the bound shares 0, 1, ... of its tokens."""
    return [math.comb(tokens, k) * least**k * (1 - least) ** (tokens - k) for k in range(tokens + 1)]


def runs_for(recall: float, least: float, tokens: int = TOKENS) -> tuple[int, int]:
    """(runs after which a pair at the bound shares some first token but for a tenth of what may be missed, runs after which it has met however deep its paths go).

    All runs draw from the same tokens, so chances are means over the number of those that the pair shares.
    """
    p = _shared(least, tokens)

    def after(miss: Callable[[float], float], most: float) -> int:
        each, runs = [miss(k / tokens) for k in range(tokens + 1)], 1
        while sum(a * m**runs for a, m in zip(p, each)) > most and runs < 64:
            runs += 1
        return runs

    return after(lambda s: 1 - s, 0.1 * (1 - recall)), after(_miss, 0.9 * (1 - recall))


def matches_for(least: float, tokens: int = TOKENS) -> int:
    """Equal min-hashes below which a pair at the bound falls less than once in a million, a thousandth of what the runs may lose."""
    total = 0.0
    for k, p in enumerate(_shared(least, tokens)):
        total += p
        if total > 1e-6:
            return k
    return tokens


_A = (seeded(TOKENS, 5) | np.uint64(1)).astype(np.uint32)
_B = seeded(TOKENS, 6).astype(np.uint32)


def shingle_sets(raw: np.ndarray, off: np.ndarray, width: int = SHINGLE) -> Iterator[np.ndarray | None]:
    """The sorted distinct shingle hashes of each text; of one with fewer words a single hash of them all, of none None."""
    starts, ends, first = word_spans(raw, off)
    words = span_hashes(raw, starts, ends)
    windows = window_hashes(words, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(windows[a : b - width + 1])
        else:
            yield window_hashes(words[a:b], b - a) ^ np.uint64(b - a) if b > a else None


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least value of each of TOKENS bijections of 32 bits over the hashes."""
    short, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(TOKENS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(short), 1024):
        out = np.minimum(out, (short[k : k + 1024, None] * _A + _B).min(axis=0))
    return out.view(np.int32)


def class_key(shingles: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(mix64(mix64(shingles).sum(keepdims=True) ^ np.uint64(len(shingles)))[0].astype(np.int64))


def with_set_keys(df: DataFrame, text: str = "text") -> DataFrame:
    """df with set_key, the name of each text's set of shingles, null for a text without words."""
    text_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int | None] = []
            for _, _, raw, off in text_slices(batch.column(batch.schema.get_field_index(text))):
                keys += [None if s is None else class_key(s) for s in shingle_sets(raw, off)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=[*batch.schema.names, "set_key"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("set_key", T.LongType())]))


ROWS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("c", T.LongType()), T.StructField("tokens", T.ArrayType(T.IntegerType(), False))])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, off in text_slices(batch.column(1)):
            sets = list(shingle_sets(raw, off))
            keys = [None if s is None else class_key(s) for s in sets]
            tokens = [None if s is None else min_hashes(s) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.int64()), pa.array(tokens, pa.list_(pa.int32()))], names=ROWS.names)


def _token(level: Column, run: Column, choice: Column) -> Column:
    return F.col("tokens")[F.pmod(level + 5 * run, F.lit(LEVELS)) + LEVELS * choice]


def _roots(classes: DataFrame, runs: range) -> DataFrame:
    """(c, run, node, n): the classes that share a run's first token."""
    first = (seeded(64, 7) % np.uint64(CHOICE)).tolist()
    start = F.array(*[F.struct(F.lit(r).alias("run"), F.xxhash64(F.lit(r), _token(F.lit(0), F.lit(r), F.lit(first[r]))).alias("node")) for r in runs])
    nodes = classes.select("c", F.explode(start).alias("e")).select("c", "e.*")
    # written first, so that both sides of the join are plain exchanges and a hot node's rows can be split
    sizes = cut(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
    return cut(nodes.join(sizes, "node").select("c", "run", "node", "n"), "nodes")


def _leaves(classes: DataFrame, few: int, runs: int) -> DataFrame:
    """(c, node, n): the leaves of each class in which it isn't alone."""
    nodes = _roots(classes, range(few))
    free_shuffles(classes.sparkSession)
    large = nodes.where(F.col("n") > LEAF).select("c").distinct()
    if not large.limit(1).count():
        return nodes.select("c", "node", "n")
    tokens = cut(classes.select("c", "tokens").join(large, "c", "left_semi"), "tokens")  # the only ones that splits read
    found, split = _split(nodes, tokens)
    if runs > few and split.limit(1).count():
        tokens = cut(tokens.join(split, "c", "left_semi"), "tokens")
        found = found.unionByName(_split(_roots(tokens, range(few, runs)), tokens)[0])
    return found


def _split(nodes: DataFrame, tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaves below these nodes, classes of the nodes that were split)."""
    found, split = [nodes.where(F.col("n") <= LEAF)], [nodes.select("c").limit(0)]
    # the level is a column, so that every level runs the same compiled code
    open_ = nodes.where(F.col("n") > LEAF).withColumn("level", F.lit(1))
    draw = F.xxhash64("node", "level")
    choice = F.pmod(draw, F.lit(CHOICE)).cast("int")
    other = F.pmod(choice + 1 + F.pmod(F.shiftright(draw, 8), F.lit(CHOICE - 1)).cast("int"), F.lit(CHOICE))
    twins = F.pmod(F.shiftright(draw, 16), F.lit(1000)) < int(1000 * TWINS)
    pick = lambda k, choice: F.xxhash64("node", 2 * F.col("level") + k, _token(F.col("level"), F.col("run"), choice))
    kids = F.explode(F.filter(F.array(pick(0, choice), F.when(twins, pick(1, other))), lambda k: k.isNotNull())).alias("kid")
    tries = F.explode(F.filter(F.transform(F.array(*map(F.lit, range(TRIES))), lambda t: F.col("first") + t), lambda level: level < LEVELS)).alias("level")
    while open_.limit(1).count():
        # about LEAF sets of a node tell which pick pays, if any; only then all its rows are made
        some = open_.where(F.pmod(F.xxhash64("c", "node"), F.floor(F.col("n") / LEAF)) == 0).withColumnRenamed("level", "first").select("c", "run", "node", tries)
        some = some.join(tokens, "c").select("node", "level", (1 + twins.cast("int")).alias("drawn"), kids)
        some = some.groupBy("node", "level", "drawn", "kid").agg(F.count(F.lit(1)).cast("double").alias("m")).groupBy("node", "level", "drawn").agg(F.sum(F.col("m") * F.col("m")).alias("asked"), (F.sum("m") / F.col("drawn")).alias("m"))
        pays = cut(some.where(F.col("asked") <= PAYS * F.col("m") * F.col("m")).groupBy("node").agg(F.min("level").alias("level")), "pays")
        found.append(open_.join(pays, "node", "left_anti").select("c", "run", "node", "n"))
        going = open_.drop("level").join(pays, "node")
        split.append(going.select("c"))
        made = cut(going.join(tokens, "c").select("c", "run", "level", kids), "kids")
        sizes = cut(made.groupBy("kid").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "sizes")
        nodes = cut(made.join(sizes, "kid").select("c", "run", F.col("kid").alias("node"), "n", (F.col("level") + 1).alias("level")), "nodes")
        done = (F.col("n") <= LEAF) | (F.col("level") >= LEVELS)
        found.append(nodes.where(done).drop("level"))
        open_ = nodes.where(~done)
    return reduce(DataFrame.unionByName, found).select("c", "node", "n"), reduce(DataFrame.union, split).distinct()


def _members(classes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Classes by leaf, with all their leaves; those of a big leaf once for each pair of blocks."""
    path = leaves.groupBy("c").agg(F.array_sort(F.collect_list("node")).alias("path"))  # as many as the runs, or as splits that paid
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    placed = leaves.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("c", "node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")
    return placed.join(classes.join(path, "c"), "c")


NEEDED = T.StructType([T.StructField("node", T.LongType()), T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("c", T.LongType()), T.StructField("mult", T.LongType()), T.StructField("mates", T.BinaryType())])


def _met_before(paths: pa.ListArray, node: int) -> np.ndarray:
    """For each pair of sets whether they share a leaf with a smaller number than this one's."""
    off = paths.offsets.to_numpy()
    flat = paths.values.to_numpy()[off[0] : off[-1]]
    owner = np.repeat(np.arange(len(paths)), np.diff(off))
    less = flat < node
    _, place, n = np.unique(flat[less], return_inverse=True, return_counts=True)
    several = n > 1
    keep = several[place]
    seen = np.zeros((len(paths), int(several.sum())), np.float32)
    seen[owner[less][keep], (np.cumsum(several) - 1)[place[keep]]] = 1
    return seen @ seen.T > 0


def _candidates(matches: int) -> Callable:
    """Of each leaf, the classes with a pair that may be similar and belongs here; mates are bits over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, ["node", "i", "j"]):
            c, node, own = (table.column(k).to_numpy() for k in ("c", "node", "own"))
            mult = table.column("mult").to_numpy()
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
            paths = table.column("path").combine_chunks()
            i_, j_ = table.column("i").to_numpy(), table.column("j").to_numpy()
            picked, mates = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a < 2:
                    continue
                order = a + np.argsort(c[a:b], kind="stable")
                mine = np.triu(~_met_before(paths.take(pa.array(order)), int(node[a])), 1)
                if i_[a] != j_[a]:
                    mine &= own[order][:, None] != own[order][None, :]
                t = sketches[order]
                for x in np.flatnonzero(mine.any(axis=1)).tolist():
                    y = np.flatnonzero(mine[x])
                    mine[x, y] = (t[y] == t[x]).sum(axis=1) >= matches
                used = np.flatnonzero(mine.any(axis=1) | mine.any(axis=0))
                if len(used):
                    picked.append(order[used])
                    mates += [row.tobytes() for row in np.packbits(mine[np.ix_(used, used)], axis=1)]
            if picked:
                at = np.concatenate(picked)
                yield pa.RecordBatch.from_arrays([pa.array(table.column(n).to_numpy()[at]) for n in ("node", "i", "j")] + [pa.array(c[at]), pa.array(mult[at]), pa.array(mates, pa.binary())], names=NEEDED.names)

    return run


SETS = T.StructType([T.StructField("c", T.LongType()), T.StructField("shingles", T.BinaryType())])


def _wanted_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles (48 bits of each hash) of the texts whose set is the class asked for."""
    for batch in batches:
        for a, b, raw, off in text_slices(batch.column(0)):
            keys, sets = [], []
            for want, s in zip(batch.column(1).slice(a, b - a).to_pylist(), shingle_sets(raw, off)):
                if s is not None and class_key(s) == want:
                    keys.append(want)
                    sets.append((s >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=SETS.names)


def _unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, in tiles of a bounded number of shingles (and one set) on either side."""
    tile = np.cumsum([len(s) for s in sets]) // TILE
    if tile[-1] == 0:
        return _common_in_tile(sets, left, right)
    out = np.zeros(len(left), np.int64)
    tiles, of = np.unique(tile[left] * (tile[-1] + 1) + tile[right], return_inverse=True)
    for k in range(len(tiles)):
        some = np.flatnonzero(of == k)
        out[some] = _common_in_tile(sets, left[some], right[some])
    return out


def _common_in_tile(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    if len(left) < 24:
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(left, right)], np.int64)
    used, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    owner = np.repeat(np.arange(len(used)), [len(sets[k]) for k in used])
    values, index, n = np.unique(np.concatenate([sets[k] for k in used]), return_inverse=True, return_counts=True)
    several = n > 1  # what only one set has is in no intersection
    index, owner = (np.cumsum(several) - 1)[index[several[index]]], owner[several[index]]
    out = np.zeros((len(used), len(used)), np.float32)
    step = max(1, (16 << 20) // max(1, 4 * len(used)))
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    for low in range(0, int(several.sum()), step):  # a dense matrix of a bounded number of shingles at a time
        a, b = np.searchsorted(index, [low, low + step])
        m = np.zeros((len(used), min(step, int(several.sum()) - low)), np.float32)
        m[owner[a:b], index[a:b] - low] = 1
        out += m @ m.T
    return out[place[: len(left)], place[len(left) :]].astype(np.int64)


LINKS = T.StructType([T.StructField("c", T.LongType()), T.StructField("links", T.LongType()), T.StructField("mate", T.LongType())])
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("jaccard", T.DoubleType())])


def _verified(least: float, pairs: bool) -> Callable:
    """Of each leaf: pairs with their similarity, or for each class its links here, weighed by copies, and the smallest class that they lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, ["node", "i", "j"]):
            c, mult = table.column("c").to_numpy(), table.column("mult").to_numpy()
            blobs, mates = table.column("shingles"), table.column("mates")
            rows: list[list[np.ndarray]] = []
            for a, b in zip(edges[:-1], edges[1:]):
                order = a + np.argsort(c[a:b], kind="stable")
                # a table may hold a document twice, so a class may have its set twice
                order = order[np.concatenate([[True], c[order][1:] != c[order][:-1]])]
                sets = [_unpacked(blobs[int(k)].as_py()) for k in order]
                bits = np.frombuffer(b"".join(mates[int(k)].as_py() for k in order), np.uint8).reshape(len(order), -1)
                left, right = np.nonzero(np.unpackbits(bits, axis=1, count=len(order)))
                common = _common(sets, left, right)
                sizes = np.array([len(s) for s in sets], np.int64)
                union = sizes[left] + sizes[right] - common
                good = common >= least * union
                left, right, common, union = left[good], right[good], common[good], union[good]
                if not len(left):
                    continue
                k = c[order]
                if pairs:
                    rows.append([k[left], k[right], common / union])
                    continue
                links, m = np.zeros(len(k), np.int64), mult[order]
                np.add.at(links, left, m[right])
                np.add.at(links, right, m[left])
                root = np.arange(len(k))
                while True:  # the smallest place that a class is linked to, from place to place
                    before = root.copy()
                    np.minimum.at(root, right, root[left])
                    np.minimum.at(root, left, root[right])
                    root = root[root]
                    if (root == before).all():
                        break
                rows.append([k[links > 0], links[links > 0], k[root][links > 0]])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], names=(PAIRS if pairs else LINKS).names)

    return run


def _sketch(tokens: str) -> Column:
    """A byte of each min-hash. Unequal ones may look equal, which lets more pairs through to the exact check, never fewer."""
    return F.unhex(F.array_join(F.transform(tokens, lambda t: F.lpad(F.hex(t.bitwiseAND(F.lit(255))), 2, "0")), ""))


def _join(df: DataFrame, text: str, least: float, recall: float, pairs: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    spark = df.sparkSession
    text_batches(spark)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = cut(docs.mapInArrow(_signatures, ROWS), "signatures")
    named = rows.where(F.col("doc_id").isNotNull() & F.col("c").isNotNull())
    classes = cut(named.groupBy("c").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("tokens").alias("tokens")), "classes")
    leaves = cut(_leaves(classes, *runs_for(recall, least)), "leaves")
    group = ["node", "i", "j"]
    members = _members(classes.select("c", "mult", _sketch("tokens").alias("sketch")), leaves)
    needed = cut(members.repartition(*group).sortWithinPartitions(*group).mapInArrow(_candidates(matches_for(least)), NEEDED), "needed")
    free_shuffles(spark)
    wanted = needed.select("c").distinct().join(classes.select("c", "rep"), "c")
    sets = docs.join(wanted, F.col("doc_id") == F.col("rep")).select("text", "c").mapInArrow(_wanted_sets, SETS)
    found = needed.join(sets, "c").repartition(*group).sortWithinPartitions(*group).mapInArrow(_verified(least, pairs), PAIRS if pairs else LINKS)
    return rows, classes, cut(found, "found")


def similar_pairs(df: DataFrame, text: str = "text", least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of pairs of classes of equal sets, each named by its smallest doc_id, with at least this similarity."""
    _, classes, found = _join(df, text, least, recall, True)
    name = classes.select("c", "rep")
    out = found.join(name.select(F.col("c").alias("a"), F.col("rep").alias("x")), "a").join(name.select(F.col("c").alias("b"), F.col("rep").alias("y")), "b")
    return out.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard")


def groups(df: DataFrame, text: str = "text", least: float = LEAST, recall: float = RECALL, keys: bool = False) -> DataFrame:
    """doc_id, class_id, copy_id, n_copies and n_links of each row of df.

    Words are runs of anything but ASCII white space, unchanged. class_id is the smallest doc_id that a row leads
    to over links of at least `least`, copy_id the smallest with the same set of shingles, n_copies their number
    and n_links the number of rows that a row is linked to, copies counted. A text with fewer than five words has
    them all as its one shingle; a null or empty text, and a row without a doc_id, has no links (n_links and
    n_copies 0, class_id and copy_id its own doc_id). Rows with the same doc_id are rows like others. Only doc_id and
    the text are read; texts are read whole. With `keys`, set_key is what with_set_keys gives for the row, null without a doc_id.
    """
    rows, classes, found = _join(df, text, least, recall, False)
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("c").alias("a"), F.col("mate").alias("b"))).withColumnRenamed("node", "c")
    known = classes.select("c", "rep", "mult").join(links, "c", "left").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    known = cut(known, "known")
    names = cut(known.groupBy("root").agg(F.min("rep").alias("class_id")), "names")
    known = known.join(names, "root").select(F.col("c").alias("k"), "class_id", F.col("rep").alias("copy_id"), F.col("mult").alias("n_copies"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    mine = F.when(F.col("doc_id").isNotNull(), F.col("c"))
    out = rows.select("doc_id", mine.alias("k")).join(known, "k", "left")
    zero = F.lit(0).cast("long")
    named = [F.col("k").alias("set_key")] if keys else []
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("n_copies", zero).alias("n_copies"), F.coalesce("n_links", zero).alias("n_links"), *named)
