"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents with the same set of sources form a pattern. Words flow from patterns to the
quotas of their sources; the k-th use of a pattern's words costs k - 1, a convex cost, so
words are repeated only where unused ones cannot fill a quota. What flows from a pattern
fixes how often each of its documents is taken: all of them a whole number of times, and
a seeded selection once more.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .sharding import BITS, hash_bits

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the selection key that one round tells apart.
DIGIT = 15
#: Rows of a small table up to which it is broadcast; more patterns than that are joined.
BROADCAST_ROWS = 10_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, int], most: int = 3) -> dict[str | None, float]:
    """Shares of the sum of sizes by weight; none over `most` times its size, and what is cut off is shared again by weight."""
    open_, out = list(sizes), {}
    left, weight = sum(sizes.values()), sum(weights.values())
    for s in sorted(open_, key=lambda s: most * sizes[s] / weights[s]):
        cap = most * sizes[s]
        if cap <= left * weights[s] / weight:
            out[s] = float(cap)
            left, weight = left - cap, weight - weights[s]
        else:
            break
    return out | {s: left * weights[s] / weight for s in sizes if s not in out}


def route(supply: dict[str, int], members: dict[str, list], quota: dict, most: int = 3) -> dict[str, int]:
    """Words that each pattern gives in a maximal flow of least cost, by successive cheapest paths.

    The graph has a node for each pattern and source and `most` edges into each pattern, whose costs
    rise, so its size depends on patterns and sources, not on documents.
    """
    nodes = {"in": 0, "out": 1}
    to, cap, cost, edges = [], [], [], []

    def node(x) -> int:
        if x not in nodes:
            nodes[x] = len(nodes)
        while len(edges) < len(nodes):
            edges.append([])
        return nodes[x]

    def edge(a, b, c, w) -> int:
        for x, y, z, v in ((a, b, c, w), (b, a, 0, -w)):
            edges[x].append(len(to))
            to.append(y), cap.append(z), cost.append(v)
        return len(to) - 2

    node("in"), node("out")
    used = {p: [edge(0, node(("p", p)), n, k) for k in range(most)] for p, n in sorted(supply.items()) if n}
    for p in sorted(used):
        for s in members[p]:
            edge(node(("p", p)), node(("s", s)), most * supply[p], 0)
    for s in quota:
        edge(node(("s", s)), 1, int(quota[s] + 0.5), 0)
    while True:
        far, back, queue, waiting = {0: 0}, {}, deque([0]), {0}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for e in edges[a]:
                if cap[e] > 0 and far[a] + cost[e] < far.get(to[e], 1 << 60):
                    far[to[e]], back[to[e]] = far[a] + cost[e], e
                    if to[e] not in waiting:
                        queue.append(to[e])
                        waiting.add(to[e])
        if 1 not in far:
            return {p: sum(cap[e ^ 1] for e in ids) for p, ids in used.items()}
        path, a = [], 1
        while a:
            path.append(back[a])
            a = to[back[a] ^ 1]
        n = min(cap[e] for e in path)
        for e in path:
            cap[e], cap[e ^ 1] = cap[e] - n, cap[e ^ 1] + n


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row for each pattern."""
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= BROADCAST_ROWS else frame


def _select(rows: DataFrame, rest: dict[str, int], keys: list[tuple[str, int]]) -> dict[str, list[int]]:
    """For each pattern the bounds (one for each key) below which rows in order of the keys add up to `rest` words, as nearly as whole rows can.

    Digit by digit: sizes are summed for each digit of the key, the digit in which the sum passes `rest` is
    fixed, and the next round looks only at rows with that digit. A round returns one row for each pattern.
    """
    spark = rows.sparkSession
    bounds: dict[str, list[int]] = {p: [] for p in rest}
    open_ = {p for p, n in rest.items() if n > 0}
    rest = dict(rest)
    for i, (key, bits) in enumerate(keys):
        prefix = dict.fromkeys(open_, 0)
        for low in range(bits - DIGIT, -DIGIT, -DIGIT):
            low = max(low, 0)
            if not open_:
                break
            width = min(DIGIT, bits - low) if low else bits % DIGIT or DIGIT
            state = [(p, prefix[p], rest[p], *[bounds[p][j] for j in range(i)]) for p in sorted(open_)]
            names = "".join(f", k{j} long" for j in range(i))
            here = rows.join(_frame(spark, state, f"pattern string, prefix long, rest long{names}"), "pattern")
            same = reduce(lambda a, b: a & b, [F.col(keys[j][0]) == F.col(f"k{j}") for j in range(i)], F.lit(True))
            here = here.where(same & (F.shiftright(key, low + width) == F.col("prefix")))
            sums = here.groupBy("pattern", "rest", F.shiftright(key, low).alias("digit")).agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
            upto = F.sum("b").over(Window.partitionBy("pattern").orderBy("digit"))
            passed = sums.withColumn("c", upto).where("c > rest").groupBy("pattern").agg(F.min(F.struct("digit", (F.col("c") - F.col("b")).alias("below"), "b", "n")).alias("x")).collect()
            found = {r.pattern: r.x for r in passed}
            for p in sorted(open_):
                if p not in found:  # all rows fit
                    bounds[p] += [1 << 62] * (len(keys) - i)
                    open_.discard(p)
                    continue
                prefix[p] = found[p].digit
                rest[p] -= found[p].below
                if found[p].n == 1 or not rest[p]:  # one row at the bound: it is taken if that comes nearer
                    nearer = found[p].n == 1 and found[p].b < 2 * rest[p]
                    bounds[p] += [found[p].digit + nearer << low] + [0] * (len(keys) - i - 1)
                    open_.discard(p)
        for p in open_:
            bounds[p].append(prefix[p])
    for p in rest:
        bounds[p] += [0] * (len(keys) - len(bounds[p]))
    return bounds


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    return any(_has_map(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else isinstance(kind, T.MapType)


def mix(df: DataFrame, sources: str = "sources", size: str = "size", key: str = "doc_id", weights=None, most: int = 3, seed: str = "mix") -> DataFrame:
    """df with source_size and target (of the first of its sources) and taken, the words the mix takes of it.

    `sources` is an array column: all sources that a row belongs to, null elements included; a row without any
    has taken 0 and a null target. Sources are in code point order, null last. `weights` maps the list of them
    to a dict of whole numbers; by default they weigh 1, 2, 3, repeating. `size` is 0 where null. Each row is
    taken a whole number of times, at most `most`; rows of equal key are told apart by size, then by their other
    columns; rows that are alike in all of them are alike to the mix too, and their place decides. So a rerun takes
    the same rows however the table is split. A pattern's selection misses its flow by at most half a document. An
    empty table gives no rows. The driver holds a row for each pattern and for each source.
    """
    spark = df.sparkSession
    free = lambda name: name if name not in df.columns else free(name + "_")
    pattern, h, content, place = free("pattern"), free("h"), free("content"), free("place")
    kept = [c for c in df.columns if c not in ("source_size", "target", "taken")]
    plain = [c for c in kept if not _has_map(df.schema[c].dataType)]
    full = df.select(*kept).withColumns({
        pattern: F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))), {"ignoreNullFields": "false"}),
        size: F.coalesce(size, F.lit(0)).cast("long"), h: hash_bits(key, seed=seed), content: F.shiftrightunsigned(F.xxhash64(*plain), 4), place: F.monotonically_increasing_id(),
    })
    full = cut(full, "full")  # places are fixed here, for the selection and for what is returned
    rows = full.select(F.col(pattern).alias("pattern"), sources, F.col(size).alias("size"), F.col(h).alias("h"), F.col(content).alias("content"), F.col(place).alias("place"))
    totals = rows.withColumnRenamed("pattern", pattern).groupBy(pattern).agg(F.sum("size").alias("n"), F.first(F.array_sort(F.array_distinct(sources))).alias("members")).collect()
    members = {r[pattern]: list(r.members or []) for r in totals}
    supply = {r[pattern]: int(r.n) for r in totals if r.members}
    names = sorted({s for m in members.values() for s in m}, key=lambda s: (s is None, s or ""))
    weigh = weights(names) if weights else {s: 1 + i % 3 for i, s in enumerate(names)}
    sizes = {s: sum(n for p, n in supply.items() if s in members[p]) for s in names}
    quota = targets(sizes, weigh, most) if names and sum(sizes.values()) else dict.fromkeys(names, 0.0)
    # overlapping sources may together ask for more than there is; the flow then fills what it can
    flow = {p: 0 for p in members} | route(supply, members, quota, most)
    copies = {p: flow[p] // supply[p] if supply.get(p) else 0 for p in members}
    rest = {p: flow[p] - copies[p] * supply.get(p, 0) for p in members}
    keys = [("h", BITS), ("size", 40), ("content", 60), ("place", 62)]
    bounds = _select(rows, rest, keys)
    first = {p: m[0] if m else None for p, m in members.items()}
    state = [(p, copies[p], sizes[first[p]] if m else None, quota[first[p]] if m else None, *bounds[p]) for p, m in members.items()]
    plan = _frame(spark, state, "pattern string, copies long, source_size long, target double, b0 long, b1 long, b2 long, b3 long")
    less = F.struct(h, size, content, place) < F.struct("b0", "b1", "b2", "b3")
    out = full.join(plan.withColumnRenamed("pattern", pattern), pattern)
    return out.select(*kept[: kept.index(size)], size, *kept[kept.index(size) + 1 :], "source_size", "target", ((F.col("copies") + less.cast("long")) * F.col(size)).alias("taken"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size / w, source NULLS LAST) AS k FROM s),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS l, (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS v FROM o),
m AS (SELECT coalesce(min(k) FILTER (WHERE NOT 3 * source_size <= l * w / v), 1 << 30) AS k FROM c),
t AS (SELECT c.source, c.source_size, CASE WHEN c.k < m.k THEN (3 * source_size)::DOUBLE ELSE (SELECT x.l FROM c x WHERE x.k = m.k) * w / (SELECT x.v FROM c x WHERE x.k = m.k) END AS target FROM c, m),
q AS (SELECT d.*, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS flow, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.size) AS cum FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (CASE WHEN source_size = 0 THEN 0 ELSE (flow // source_size + CASE WHEN flow % source_size >= cum OR 2 * cum - size < 2 * (flow % source_size) THEN 1 ELSE 0 END) * size END)::BIGINT AS taken FROM q
"""
