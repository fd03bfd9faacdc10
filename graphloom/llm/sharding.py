"""Sharding by extendible hashing, in DataFrame functions alone.

A row's bucket is a prefix of the bits of its hash. The directory starts with the empty
prefix; a bucket over the byte limit is split on the next bit, until every bucket fits or
holds a single row. Bytes are summed once at a depth that fits as a rule; the sums of all
shorter prefixes follow from those, and a bucket is the shortest prefix that fits.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BITS = 60
LIMIT = 64 << 20


def hash_bits(*columns: Column | str, seed: str = "") -> Column:
    """The first 60 bits of the MD5 of the columns as text, which other engines can reproduce."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("null")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _buckets(rows: DataFrame, depth: int, limit: int) -> DataFrame:
    """For each (g, prefix of `depth` bits) that a row has: the shortest prefix that fits (none: null), its bytes and rows."""
    leaves = rows.groupBy("g", F.shiftright("h", BITS - depth).alias("leaf")).agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"))
    levels = leaves.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    levels = levels.withColumn("p", F.expr(f"shiftright(leaf, {depth} - d)"))
    sums = levels.groupBy("g", "d", "p").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    fits = sums.where((F.col("b") <= limit) | (F.col("n") == 1))
    found = levels.select("g", "leaf", "d", "p").join(fits, ["g", "d", "p"]).groupBy("g", "leaf").agg(F.min(F.struct("d", "p", "b", "n")).alias("s"))
    return leaves.select("g", "leaf").join(found, ["g", "leaf"], "left")


RESULTS = ("n_bytes", "shard_depth", "shard_prefix", "shard_tie", "shard_bytes", "shard_rows")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(key, n_bytes, shard_depth, shard_prefix, shard_tie, shard_bytes, shard_rows) of every row of df.

    n_bytes is the text's UTF-8 length, 0 for null. A null key is a key like any other. Rows whose keys are
    equal share all 60 bits; if they don't fit together they are split by the bits of a second hash, of
    their place in the table, and shard_tie is 1 plus that directory's prefix with its depth in front (else 0).
    A single row over the limit has a bucket of its own. An empty table gives no rows. Other columns are left out;
    a key with the name of a result raises.
    """
    return _placed(df, key, text, limit)


def _placed(df: DataFrame, key: str, text: str, limit: int, carried: tuple[Column, ...] = ()) -> DataFrame:
    """What shard returns, with further columns of each row behind it."""
    if key in RESULTS:
        raise ValueError(f"the key has the name of a result: {key}")
    name, key = key, "_key"
    rows = cut(df.select(F.col(name).alias(key), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(name).alias("h"), *carried), "sizes")
    kept = rows.columns[3:]
    rows = rows.withColumn("g", F.lit(0).cast("long"))
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth, done, tie = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 3), [], False
    while True:
        leaf = F.shiftright("h", BITS - depth)
        placed = rows.withColumn("leaf", leaf).join(_buckets(rows, depth, limit), ["g", "leaf"])
        prefix = F.col("s.p")
        out = placed.select(
            key, "n_bytes",
            (F.lit(BITS) if tie else F.col("s.d")).cast("int").alias("shard_depth"), (F.col("g") if tie else prefix).alias("shard_prefix"),
            (prefix + F.expr("shiftleft(CAST(1 AS BIGINT), s.d)") if tie else F.lit(0).cast("long")).alias("shard_tie"),
            F.col("s.b").alias("shard_bytes"), F.col("s.n").alias("shard_rows"), F.col("s").isNull().alias("open"), "h", "g", *kept,
        )
        left = out.where("open").select("g").limit(1).count() if depth < BITS or not tie else 0
        done.append(out.where(~F.col("open")).drop("open", "h", "g"))
        if not left:
            break
        rows = cut(out.where("open").select(key, "n_bytes", "h", "g", *kept), "open")
        if depth < BITS:
            depth = min(BITS, depth + 8)
        else:  # equal keys: the place in the table tells rows apart
            rows, tie, depth = cut(rows.select(key, "n_bytes", hash_bits(F.monotonically_increasing_id(), seed="tie").alias("h"), F.col("h").alias("g"), *kept), "ties"), True, 24
    return reduce(DataFrame.unionByName, done).withColumnRenamed(key, name)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Write df to folders shard=<depth>-<prefix>-<tie>. One bucket is one task, and none is over the limit but for a single row.

    Rows are carried through the split, so each is written once, in the shard decided for it: a key doesn't tell rows apart.
    """
    placed = _placed(df, key, text, limit, (F.struct(*df.columns).alias("_row"),))
    out = placed.select("_row.*", F.concat_ws("-", "shard_depth", "shard_prefix", "shard_tie").alias("shard"))
    out.repartition("shard").write.partitionBy("shard").parquet(path)


def oracle(limit: int = LIMIT) -> str:
    """SQL for shard over documents, down to a depth of 30, where keys are distinct."""
    return ORACLE.replace(f"s.b <= {LIMIT} ", f"s.b <= {limit} ")


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5('|' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
l AS (SELECT d.*, k::INTEGER AS depth, h >> ({BITS} - k)::INTEGER AS p FROM d, range(0, 31) AS r(k)),
s AS (SELECT depth, p, sum(n_bytes)::BIGINT AS b, count(*) AS n FROM l GROUP BY ALL),
f AS (SELECT l.doc_id, l.n_bytes, l.depth, l.p, s.b, s.n, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.depth) AS r FROM l JOIN s ON l.depth = s.depth AND l.p = s.p WHERE s.b <= {LIMIT} OR s.n = 1)
SELECT doc_id, n_bytes, depth AS shard_depth, p AS shard_prefix, 0::BIGINT AS shard_tie, b AS shard_bytes, n AS shard_rows FROM f WHERE r = 1
"""
