"""Chat formatting by perspective rotation: a dialogue is rendered once for each participant, who is the assistant in it.

Turns are put in order over the whole table by ranges, numbered within their conversation as
they stream by, and rendered in parts of PART_TURNS turns or PART_BYTES of text, so that no
task holds more of one conversation however long it is, numbered or not. Each part knows
where it begins in the whole rendering, so parts in order make up the whole, masks too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_bytes

PART_TURNS = 256
PART_BYTES = 8 << 20
#: Bytes of text of a range of turns.
RANGE_BYTES = 32 << 20
#: Roles that set the scene and never become the assistant.
NARRATORS = ("system",)
#: Fixed values of the rendered format. A text's or role's own marks get a space, so that none can forge a turn.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def numbered(df: DataFrame) -> DataFrame:
    """(conv, role, text, pos, before) of all turns: the number of turns of its conversation before each, and the bytes of their texts."""
    spark = df.sparkSession
    turns = df.select(F.col("conv_id").alias("conv"), F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows, size = text_bytes(turns)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size + 64 * rows) // RANGE_BYTES))
    # equal rows are told apart by their place, so that even they are spread; they are alike, so their order doesn't matter
    keys = ["conv", "known", "turn", "role", "text", "place"]
    dealt = turns.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(int(ranges), *keys).sortWithinPartitions(*keys)
    schema = T.StructType([turns.schema["conv"], turns.schema["role"], turns.schema["text"], *[T.StructField(n, T.LongType()) for n in ("range", "run", "pos", "before")]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, run, pos, before = TaskContext.get().partitionId(), None, -1, 0, 0
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for conv, n in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if run < 0 or conv != last:
                    last, run, pos, before = conv, run + 1, 0, 0
                for column, x in zip(out, (run, pos, before)):
                    column.append(x)
                pos, before = pos + 1, before + n
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([here] * batch.num_rows), *[pa.array(x, pa.int64()) for x in out]], names=schema.names)

    found = cut(dealt.select("conv", "role", "text", F.octet_length("text").alias("n")).mapInArrow(count, schema), "turns")
    # only a range's first conversation may have begun before: a row for each range comes to the driver
    end = F.struct("run", "pos")
    size_of = F.col("before") + F.octet_length("text")
    ends = found.groupBy("range").agg(F.min_by(F.struct("conv"), end).alias("first"), F.max_by(F.struct("conv", "run", (F.col("pos") + 1).alias("n"), size_of.alias("b")), end).alias("last")).orderBy("range").collect()
    begun, conv, n, b = [], None, 0, 0
    for r in ends:
        goes_on = n > 0 and r["first"].conv == conv
        if goes_on:
            begun.append((r["range"], n, b))
        alone = goes_on and r["last"].run == 0
        conv, n, b = r["last"].conv, r["last"].n + (n if alone else 0), r["last"].b + (b if alone else 0)
    if begun:
        base = F.broadcast(spark.createDataFrame(begun, "range long, n long, b long")).withColumn("run", F.lit(0).cast("long"))
        found = found.join(base, ["range", "run"], "left").withColumns({"pos": F.col("pos") + F.coalesce("n", F.lit(0)), "before": F.col("before") + F.coalesce("b", F.lit(0))})
    return found.select("conv", "role", "text", "pos", "before")


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def perspectives(df: DataFrame, narrators: tuple[str, ...] = NARRATORS, part_turns: int = PART_TURNS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(conv_id, participant, part, start, rendered, mask, n_turns) for every participant of every conversation.

    The participant's turns are headed `assistant`, others' `user name=<role>`, narrators' by their role, and turns
    without a role `user`. Parts in order of their numbers make up the whole rendering, and `start` is the number of
    characters before a part. `mask` holds the [start, end) character places in the part's `rendered` of what the
    participant says, the closing mark included: what a loss is taken on. Turns go by number, ties by role, then
    text; repeated rows are repeated turns. `<|` in a text or role becomes `< |`, a line feed in a role a space. Null texts are empty;
    turns without a number come first; a null conv_id is a conversation like any other; one without a participant
    gives no rows. Other columns are left out.
    """
    turns = cut(numbered(df).withColumn("part", F.floor(F.col("pos") / part_turns) + F.floor(F.col("before") / part_bytes)), "numbered")
    parts = turns.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns"))
    who = turns.where((F.col("role") != "") & ~F.col("role").isin(*narrators)).select(F.col("conv").alias("c"), F.col("role").alias("participant")).distinct()
    rows = parts.join(who, parts.conv.eqNullSafe(who.c)).drop("c")

    def head(t: Column) -> Column:
        name = F.when(t.role == F.col("participant"), F.lit("assistant")).when(t.role.isin(*narrators), t.role).when(t.role == "", F.lit("user")).otherwise(F.concat(F.lit("user name="), F.replace(_safe(t.role), F.lit("\n"), F.lit(" "))))
        return F.concat(F.lit(OPEN), name, F.lit(MIDDLE))

    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(_safe(t.text), F.lit(CLOSE)).alias("said"), (t.role == F.col("participant")).alias("own")))
    rows = rows.withColumn("pieces", pieces)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask"))

    def add(s: Column, p: Column) -> Column:
        begin = s.at + F.length(p.head)
        end = begin + F.length(p.said)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p.own, F.concat(s.mask, span)).otherwise(s.mask).alias("mask"))

    found = F.aggregate("pieces", empty, add)
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p.head, p.said)), "")
    out = cut(rows.select("conv", "participant", "part", text.alias("rendered"), found.mask.alias("mask"), F.size("turns").cast("long").alias("n_turns")), "rendered")
    # only conversations of several parts need their starts summed
    several = turns.where("part > 0").select("conv").distinct()
    if not several.limit(1).count():
        return out.select(F.col("conv").alias("conv_id"), "participant", "part", F.lit(0).cast("long").alias("start"), "rendered", "mask", "n_turns")
    sizes = out.select("conv", "participant", "part", F.length("rendered").cast("long").alias("n")).join(several.withColumnRenamed("conv", "v"), F.col("conv").eqNullSafe(F.col("v")), "left_semi")
    earlier = Window.partitionBy("conv", "participant").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("conv").alias("c"), F.col("participant").alias("p"), F.col("part").alias("q"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")).where("start > 0")
    out = out.join(starts, F.col("conv").eqNullSafe(F.col("c")) & (F.col("participant") == F.col("p")) & (F.col("part") == F.col("q")), "left")
    return out.select(F.col("conv").alias("conv_id"), "participant", "part", F.coalesce("start", F.lit(0)).alias("start"), "rendered", "mask", "n_turns")


def digests(df: DataFrame) -> DataFrame:
    """conv_id, participant, part, start, n_turns, rendered_sha256, mask (as `start-end` joined by commas) and n_mask_chars."""
    out = perspectives(df)
    return out.select(
        "conv_id", "participant", "part", "start", "n_turns", F.sha2(F.col("rendered").cast("binary"), 256).alias("rendered_sha256"),
        F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m.start.cast("string"), m.end.cast("string"))), ",").alias("mask"),
        F.aggregate("mask", F.lit(0).cast("long"), lambda s, m: s + m.end - m.start).alias("n_mask_chars"),
    )


ORACLE = f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
b AS (SELECT *, row_number() OVER w AS k, coalesce(sum(strlen(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
t AS (SELECT *, ((k - 1) // {PART_TURNS} + before // {PART_BYTES})::BIGINT AS part, replace(text, '<|', '< |') AS safe FROM b),
w AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role NOT IN ('', 'system')),
s AS (SELECT t.*, w.participant, '{OPEN}' || CASE WHEN t.role = w.participant THEN 'assistant' WHEN t.role = 'system' THEN t.role WHEN t.role = '' THEN 'user' ELSE 'user name=' || replace(replace(t.role, '<|', '< |'), chr(10), ' ') END || chr(10) AS head, safe || '<|im_end|>' || chr(10) AS said FROM t JOIN w ON t.conv_id IS NOT DISTINCT FROM w.conv_id),
p AS (SELECT *, sum(length(head) + length(said)) OVER (PARTITION BY conv_id, participant, part ORDER BY k) AS stop FROM s),
g AS (SELECT conv_id, participant, part, count(*) AS n_turns, sha256(string_agg(head || said, '' ORDER BY k)) AS rendered_sha256, coalesce(string_agg(CASE WHEN role = participant THEN (stop - length(said))::BIGINT::VARCHAR || '-' || stop::BIGINT::VARCHAR END, ',' ORDER BY k), '') AS mask, coalesce(sum(CASE WHEN role = participant THEN length(said) END), 0)::BIGINT AS n_mask_chars, sum(length(head) + length(said)) AS size FROM p GROUP BY conv_id, participant, part)
SELECT conv_id, participant, part, coalesce(sum(size) OVER (PARTITION BY conv_id, participant ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, n_turns, rendered_sha256, mask, n_mask_chars FROM g
"""
