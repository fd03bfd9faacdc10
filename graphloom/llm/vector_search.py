"""Nearest neighbours by inner product over cells of randomly rotated one-bit codes.

Every vector lies in the cell of its nearest centre; centres come from a bounded sample, all
rows are assigned. A vector less its cell's centre is scaled to length one, turned into a
space of at least BITS dimensions by a random matrix with orthonormal rows, and kept as the
signs of its coordinates, with two scalars: its length, and the product of the turned vector
and its own code, which corrects the estimate. The estimate of an inner product has a known
spread, so vectors whose estimate plus bound stays under a score that k others reach cannot
be among the nearest; all others are ranked by their exact products.

A query first searches its best cell. The k-th score found there is a floor: a cell whose
centre and radius allow no score above it is never looked at. Blocks of a cell meet groups
of queries by (cell, block, group), so tasks are many and each holds one block and one
group. Vectors travel with their codes: a block meets hundreds of queries at once, which
between them rank most of it, so fetching vectors one by one would move more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, grouped

#: Vectors of a block, which is also what cells hold on average until there are CELLS of them; queries of a group.
BLOCK = 4096
QUERIES = 1024
CELLS = 1024
#: Rows that the centres are fitted on, at most.
SAMPLE = 16_384
#: Bits of a code at least: an estimate's error falls with their root.
BITS = 256
#: Bound of an estimate's error in standard deviations: one in thirty thousand is further off.
DEVIATIONS = 4.0
#: Queries whose estimates are one matrix product, and pairs ranked at once.
STEP = 64
PAIRS = 65_536


def rotation(dims: int, bits: int | None = None, seed: int = 17) -> np.ndarray:
    """A random (dims, bits) matrix with orthonormal rows that depends on its shape and seed alone; square by default."""
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((bits or dims, dims)))
    return (q * np.sign(np.diag(r))).T


def code_bits(dims: int) -> int:
    return max(BITS, -(-dims // 8) * 8)


def _fine(v: str, dims: int | None = None):
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return fine if dims is None else (F.size(v) == dims) & fine


def valid(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """(k, v) of rows that take part, their dimension (the length that most vectors have, of equals the least) and their number."""
    element = df.schema[vector].dataType.elementType
    v = F.col(vector).cast(T.ArrayType(element if isinstance(element, T.FloatType) else T.DoubleType()))
    rows = df.select(F.col(key).cast("long").alias("k"), v.alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull()).where(_fine("v"))
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (rows.where(F.size("v") == most.d), most.d, most["count"]) if most else (rows, 0, 0)


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def k_means(x: np.ndarray, cells: int, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """At most `cells` centres of the rows of x; those that no row is nearest to are left out."""
    x = x.astype(np.float64)
    centres = x[np.random.RandomState(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = _nearest_centre(x, centres)
        used, place, n = np.unique(near, return_inverse=True, return_counts=True)
        centres = np.zeros((len(used), x.shape[1]))
        np.add.at(centres, place, x / n[place][:, None])
    return centres


def _nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return ((centres * centres).sum(axis=1) - 2 * (x.astype(np.float64) @ centres.T)).argmin(axis=1)


@dataclass
class Cells:
    """At most CELLS centres with the distance of their farthest vector and the number of their blocks."""

    centres: np.ndarray
    radii: np.ndarray
    blocks: np.ndarray

    def frame(self, spark: SparkSession, name: str, counts: np.ndarray) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(c, int(n)) for c, n in enumerate(counts)], f"cell int, {name} int"))  # a row for each cell


BLOCKS = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("vb", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in ("ids", "codes", "norms", "fits", "vectors")]])


def encode_block(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, lengths, products of the turned vectors and their codes) of vectors less their centre."""
    with np.errstate(all="ignore"):
        off = x.astype(np.float64) - centre
        norms = np.sqrt((off * off).sum(axis=1))
        turned = off @ turn / np.maximum(norms, 1e-300)[:, None]
        return np.packbits(turned > 0, axis=1), norms, np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[1])


def build_index(rows: DataFrame, dims: int, n: int) -> tuple[DataFrame, Cells]:
    """Blocks of packed codes, scalars and vectors of every row, written to the shared folder, and their cells.

    A cell of many rows, of one repeated vector too, goes to as many blocks as its number asks for.
    """
    spark = rows.sparkSession
    cells = max(1, min(CELLS, n // BLOCK))
    wanted = min(SAMPLE, 256 * cells, n)
    order = F.xxhash64("k", "v")
    share = F.lit(int(-(2**63) + min(1.0, 2 * wanted / n + 64 / n) * (2**64 - 1025)))
    sample = np.array([r.v for r in rows.where(order <= share).orderBy(order, "k").limit(wanted).select("v").collect()])
    centres = k_means(sample, cells)
    element = rows.schema["v"].dataType

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            cell = _nearest_centre(x, centres)
            with np.errstate(all="ignore"):
                far = np.sqrt(((x.astype(np.float64) - centres[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(far)], names=["k", "v", "cell", "far"])

    placed = cut(rows.mapInArrow(assign, T.StructType([T.StructField("k", T.LongType()), T.StructField("v", element), T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])), "placed")
    radii, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        radii[r.cell], counts[r.cell] = r.far, r.n
    found = Cells(centres, radii, -(-counts // BLOCK))
    turn = rotation(dims, code_bits(dims))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["cell", "vb"]):
            cell, vb = table.column("cell")[0], table.column("vb")[0]
            x = _matrix(table.column("v"), dims)
            parts = (table.column("k").to_numpy(), *encode_block(x, centres[cell.as_py()], turn), np.ascontiguousarray(x))
            yield pa.RecordBatch.from_arrays([pa.array([cell.as_py()], pa.int32()), pa.array([vb.as_py()], pa.int32()), *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=BLOCKS.names)

    # the table is at rest, so that a row's place in it is the same whenever a task is run again
    dealt = placed.join(found.frame(spark, "blocks", found.blocks), "cell").select("cell", F.pmod(F.hash(F.monotonically_increasing_id()), F.col("blocks")).alias("vb"), "k", "v")
    return cut(dealt.repartition(_tasks(found.blocks.sum()), "cell", "vb").sortWithinPartitions("cell", "vb").mapInArrow(pack, BLOCKS), "index"), found


def _tasks(n) -> int:
    return int(max(1, min(2 * n, 20_000)))


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added in order of the dimensions."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d].astype(np.float64) * q[:, d].astype(np.float64)
    return out


class Block:
    """One block's codes, ready to be multiplied with queries."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, norms: np.ndarray, fits: np.ndarray, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        bits = turn.shape[1]
        self.ids, self.x, self.centre, self.turn = ids, x, centre, turn
        safe = np.maximum(fits, 1e-12)
        signs = np.unpackbits(codes, axis=1, count=bits).astype(np.float32) * 2 - 1
        with np.errstate(all="ignore"):
            self.bound = (norms * (DEVIATIONS * np.sqrt(np.maximum(1 - fits * fits, 0)) / safe / np.sqrt(bits - 1) + 1e-5)).astype(np.float32)
            self.signs = np.hstack([signs * (norms / np.sqrt(bits) / safe).astype(np.float32)[:, None], self.bound[:, None]])
            # how far a product in the vectors' own precision may be off, for a query of length one
            self.slack = 4 * x.shape[1] * np.finfo(x.dtype).eps * np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))
        self.order = np.argsort(ids, kind="stable")

    def search(self, q: np.ndarray, own: np.ndarray | None, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(place of the query, id, score) of at most k vectors for each query with no score under its floor, and how many pairs were ranked."""
        out, ranked = [], 0
        for a in range(0, len(q), STEP):
            place, found, scores, n = self._some(q[a : a + STEP], None if own is None else own[a : a + STEP], floor[a : a + STEP], k)
            out.append((place + a, found, scores))
            ranked += n
        return *[np.concatenate(c) for c in zip(*out)], ranked

    def _some(self, q, own, floor, k):
        q64 = q.astype(np.float64)
        with np.errstate(all="ignore"):
            length, rest = np.sqrt((q64 * q64).sum(axis=1)), q64 @ self.centre
            most = np.hstack([q64 @ self.turn, length[:, None]]).astype(np.float32) @ self.signs.T  # estimate plus bound, less the centre's share
        floor = floor.copy()
        ids = self.ids[self.order]
        mine = [self.order[np.searchsorted(ids, o) : np.searchsorted(ids, o, side="right")] for o in own] if own is not None else [[]] * len(q)
        for i in np.flatnonzero(floor == -np.inf):
            estimate = most[i] - length[i].astype(np.float32) * self.bound
            estimate[mine[i]] = -np.inf
            if len(estimate) - len(mine[i]) > 2 * k:  # the exact scores of the most promising give a floor
                first = np.argpartition(-estimate, 2 * k)[: 2 * k]
                floor[i] = np.partition(exact(self.x[first], np.broadcast_to(q[i], (2 * k, q.shape[1]))), k)[k]
        with np.errstate(all="ignore"):
            near = ~(most < (floor - rest - 1e-6 * length * (1 + self.slack)).astype(np.float32)[:, None])
        for i, m in enumerate(mine):
            near[i, m] = False
        row, col = np.nonzero(near)
        with np.errstate(all="ignore"):
            if len(row) > near.size // 4:
                rough = (q.astype(self.x.dtype) @ self.x.T)[row, col]
            else:
                rough = np.concatenate([np.zeros(0, self.x.dtype), *[np.einsum("ij,ij->i", self.x[col[b : b + PAIRS]], q[row[b : b + PAIRS]]) for b in range(0, len(row), PAIRS)]])
            least = floor - length * self.slack
            edges = np.searchsorted(row, np.arange(len(q) + 1))
            for i, (b, e) in enumerate(zip(edges[:-1], edges[1:])):
                if e - b > k:
                    least[i] = np.fmax(least[i], np.partition(rough[b:e], e - b - k)[e - b - k] - 2 * length[i] * self.slack)
            stay = ~(rough < least[row])
        n, row, col = len(row), row[stay], col[stay]
        scores = np.concatenate([np.zeros(0), *[exact(self.x[col[b : b + PAIRS]], q[row[b : b + PAIRS]]) for b in range(0, len(row), PAIRS)]])
        found = self.ids[col]
        order = np.lexsort((found, -scores, row))
        row, found, scores = row[order], found[order], scores[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], found[keep], scores[keep], n


GROUPS = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("g", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in ("q", "qk", "floor", "qv")]])
FOUND = "q long, query_id long, vec_id long, score double"


def _search(index: DataFrame, cells: Cells, asked: DataFrame, dims: int, dtype, k: int, own: bool) -> DataFrame:
    """(q, query_id, vec_id, score): the best of each block for each query (q, k, v, floor, cell) of its cell."""
    spark = index.sparkSession
    counts = np.zeros(len(cells.centres), np.int64)
    for r in asked.groupBy("cell").count().collect():
        counts[r.cell] = r["count"]
    groups = -(-counts // QUERIES)
    per_cell = cells.frame(spark, "groups", groups)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, ["cell", "g"]):
            head = [pa.array([table.column(c)[0].as_py()], pa.int32()) for c in ("cell", "g")]
            parts = [table.column(c).to_numpy() for c in ("q", "k", "floor")] + [np.ascontiguousarray(_matrix(table.column("v"), dims))]
            yield pa.RecordBatch.from_arrays([*head, *[pa.array([p.tobytes()], pa.binary()) for p in parts]], names=GROUPS.names)

    dealt = asked.join(per_cell, "cell").withColumn("g", F.pmod(F.hash("q"), F.col("groups"))).select("cell", "g", "q", "k", "floor", "v")
    packed = dealt.repartition(_tasks(groups.sum()), "cell", "g").sortWithinPartitions("cell", "g").mapInArrow(pack, GROUPS)
    tasks = _tasks((groups * cells.blocks).sum())
    left = index.join(per_cell, "cell").where("groups > 0").withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = packed.join(cells.frame(spark, "blocks", cells.blocks), "cell").withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    on = ["cell", "vb", "g"]
    pairs = left.repartition(tasks, *on).join(right.repartition(tasks, *on), on).select("cell", "ids", "codes", "norms", "fits", "vectors", "q", "qk", "floor", "qv")
    turn, centres = rotation(dims, code_bits(dims)), cells.centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(j)[i].as_buffer() for j in range(1, 10)]
                ids, norms, fits = np.frombuffer(raw[0], np.int64), np.frombuffer(raw[2]), np.frombuffer(raw[3])
                block = Block(ids, np.frombuffer(raw[1], np.uint8).reshape(len(ids), -1), norms, fits, np.frombuffer(raw[4], dtype).reshape(-1, dims), centres[batch.column(0)[i].as_py()], turn)
                q, keys = np.frombuffer(raw[5], np.int64), np.frombuffer(raw[6], np.int64)
                place, found, scores, _ = block.search(np.frombuffer(raw[8], dtype).reshape(-1, dims), keys if own else None, np.frombuffer(raw[7]), k)
                yield pa.RecordBatch.from_arrays([pa.array(q[place]), pa.array(keys[place]), pa.array(found), pa.array(scores)], names=["q", "query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return pairs.mapInArrow(run, FOUND).withColumn("rank", rank).where(F.col("rank") <= k)


def _wanted(cells: Cells, dims: int) -> Callable:
    """Queries once for each further cell that may hold a score above their floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), dims).astype(np.float64)
            floor, first = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            with np.errstate(all="ignore"):
                most = x @ cells.centres.T + np.sqrt((x * x).sum(axis=1))[:, None] * cells.radii * (1 + 1e-9)
                need = ~(most < (floor - 1e-9 * np.abs(floor))[:, None])
            need &= cells.blocks > 0
            need[np.arange(len(x)), first] = False
            row, cell = np.nonzero(need)
            for a in range(0, len(row), BLOCK):
                some = batch.take(pa.array(row[a : a + BLOCK]))
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(cell[a : a + BLOCK].astype(np.int32))], names=["q", "k", "v", "floor", "cell"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", own: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k vectors with the largest inner product for each query, ties to the smaller key.

    `own`: a query's own key is no candidate. Vectors that are null, zero, hold null or non-finite components or have
    another than the commonest length take no part, nor do rows without a key, on either side. Repeated keys are
    vectors of their own, ranked side by side; a query repeated with its vector is asked once. Fewer candidates than k
    give them all; empty tables give no rows. Vectors of floats are kept as floats, others as doubles; scores are doubles.
    Other columns are left out.
    """
    spark = vectors.sparkSession
    rows, dims, n = valid(vectors, key, vector)
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    element = rows.schema["v"].dataType
    dtype = np.float32 if isinstance(element.elementType, T.FloatType) else np.float64
    index, cells = build_index(rows, dims, n)
    asked = queries.select(F.col(key).cast("long").alias("k"), F.col(vector).cast(element).alias("v")).where(F.col("k").isNotNull() & _fine("v", dims)).dropDuplicates()
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("k", T.LongType()), T.StructField("v", element), T.StructField("floor", T.DoubleType()), T.StructField("cell", T.IntegerType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(all="ignore"):
                cell = np.where(cells.blocks > 0, _matrix(batch.column(2), dims).astype(np.float64) @ cells.centres.T, -np.inf).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(cell), -np.inf)), pa.array(cell.astype(np.int32))], names=schema.names)

    asked = cut(asked.select(F.monotonically_increasing_id().alias("q"), "k", "v").mapInArrow(best, schema), "asked")
    found = _search(index, cells, asked, dims, dtype, k, own)
    if len(cells.centres) > 1:
        found = cut(found, "first")
        floors = found.where(F.col("rank") == k).select("q", F.col("score").alias("reached"))
        more = asked.join(floors, "q", "left").select("q", "k", "v", F.coalesce("reached", "floor").alias("floor"), "cell")
        more = cut(more.mapInArrow(_wanted(cells, dims), schema), "more")
        found = found.drop("rank").unionByName(_search(index, cells, more, dims, dtype, k, own).drop("rank"))
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH l AS (SELECT len(embedding) AS d FROM embeddings WHERE embedding IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings, l WHERE vec_id IS NOT NULL AND len(embedding) = d),
f AS (SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM f q JOIN f c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 20
"""
