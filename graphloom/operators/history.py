"""The log of commits: events derived from changes and what was there before."""

from __future__ import annotations

import datetime as dt
import threading
import time
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .changes import last_write
from .store import Graph

CREATED, DELETED, CHANGED, LINKED, UNLINKED = "ObjCreated", "ObjDeleted", "FldChanged", "AsoAdded", "AsoRemoved"

COLUMNS = ("commit_id", "ts", "user_id", "obj_id", "seq", "type", "fld_id", "obj_b", "fld_b", "old_value", "new_value", "typ_id")


class CommitIds:
    """Rising ids: milliseconds since 1970, and a counter within one in the low 16 bits."""

    def __init__(self) -> None:
        self._last, self._lock = 0, threading.Lock()

    def next(self, now: float | None = None) -> int:
        with self._lock:
            self._last = max(self._last + 1, int((time.time() if now is None else now) * 1000) << 16)
            return self._last


def field_events(changes: DataFrame, base: DataFrame) -> DataFrame:
    """Changed fields: (obj_id, fld_id, seq, new_value) against base (obj_id, fld_id, value); the last write of each, and none that changes nothing."""
    last = last_write(changes, ["obj_id", "fld_id"], ["seq"])
    joined = last.join(base.select("obj_id", "fld_id", F.col("value").alias("old_value")), ["obj_id", "fld_id"], "left")
    return joined.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select("obj_id", "fld_id", "seq", "old_value", "new_value", F.lit(CHANGED).alias("type"))


def edge_events(changes: DataFrame) -> DataFrame:
    """Added and removed edges (obj_a, fld_a, obj_b, fld_b, seq, added), recorded for the objects at both ends."""
    kind: Column = F.when(F.col("added"), F.lit(LINKED)).otherwise(F.lit(UNLINKED))
    ends = F.array(F.struct(F.col("obj_a").alias("obj_id"), F.col("fld_a").alias("fld_id"), F.col("obj_b"), F.col("fld_b")), F.struct(F.col("obj_b").alias("obj_id"), F.col("fld_b").alias("fld_id"), F.col("obj_a").alias("obj_b"), F.col("fld_a").alias("fld_b")))
    return changes.select("seq", kind.alias("type"), F.explode(ends).alias("e")).select("seq", "type", "e.obj_id", "e.fld_id", "e.obj_b", "e.fld_b")


def long_values(graph: Graph) -> DataFrame:
    """(obj_id, fld_id, value as text) of all present fields; an entity's rows are read once."""
    parts = []
    for key, table in graph.tables.items():
        fields = [f for f in graph.catalog.fields(key) if f in table.columns]
        if fields:
            pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("fld_id"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
            parts.append(table.select(F.col("obj_id").cast("string").alias("obj_id"), pairs).select("obj_id", "p.*").where(F.col("value").isNotNull()))
    return reduce(DataFrame.unionAll, parts)


def _edges_of_deleted(graph: Graph, gone: DataFrame) -> list[DataFrame]:
    """The graph's edges at either end of deleted objects (obj_id, typ, seq), one frame for each end of a reference that their types have."""
    types = {r.typ for r in gone.select("typ").distinct().collect()}
    parts = []
    for owner, entity in graph.catalog.entities.items():
        for r in entity.refs:
            if r.side != "a" or r.edge not in graph.edges:
                continue
            links = graph.links(r).select(F.col("a").cast("string").alias("obj_a"), F.lit(r.key).alias("fld_a"), F.col("b").cast("string").alias("obj_b"), F.lit(r.inverse).alias("fld_b"))
            for end, key in (("obj_a", owner), ("obj_b", r.target)):
                kin = types & {*graph.catalog.descendants(key), *(e.key for e in graph.catalog.lineage(key))}
                if kin:
                    mine = gone.where(F.col("typ").isin(sorted(kin))).select(F.col("obj_id").alias(end), "seq")
                    parts.append(links.join(mine, end).select("obj_a", "fld_a", "obj_b", "fld_b", "seq", F.lit(False).alias("added")))
    return parts


EDGE = ("obj_a", "fld_a", "obj_b", "fld_b")


def _edges_at(graph: Graph, linked: DataFrame) -> DataFrame:
    """EDGE of the graph's edges with an object that a change of the same reference names."""
    parts = [linked.select(*EDGE).limit(0)]
    wanted = {(r.fld_a, r.fld_b) for r in linked.select("fld_a", "fld_b").distinct().collect()}  # references of the catalog
    for entity in graph.catalog.entities.values():
        for r in entity.refs:
            if r.side == "a" and r.edge in graph.edges and (r.key, r.inverse) in wanted:
                links = graph.links(r).select(F.col("a").cast("string").alias("obj_a"), F.lit(r.key).alias("fld_a"), F.col("b").cast("string").alias("obj_b"), F.lit(r.inverse).alias("fld_b"))
                mine = linked.where((F.col("fld_a") == r.key) & (F.col("fld_b") == r.inverse))
                parts += [links.join(mine.select(end).where(F.col(end).isNotNull()).distinct(), end, "left_semi") for end in ("obj_a", "obj_b")]
    return reduce(DataFrame.unionByName, parts).distinct()


def _all_of(linked: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """Removals of the edges whose `end` a change unlinks from all its targets."""
    other = "obj_b" if end == "obj_a" else "obj_a"
    cleared = linked.where(~F.col("added") & F.col(other).isNull()).select(end, "fld_a", "fld_b", "seq")
    return edges.join(cleared, [end, "fld_a", "fld_b"]).select(*EDGE, "seq", F.lit(False).alias("added"))


def commit_events(graph: Graph, changes: DataFrame, commit_id: int, ts: dt.datetime, user: str) -> DataFrame:
    """All events of one commit from a session's changes; what is set on an object that the commit deletes isn't listed, its edges are, those that the graph held before too."""
    deletes = last_write(changes.where(F.col("op").isin("create", "delete")).select("obj_id", "seq", "op", "typ"), ["obj_id"], ["seq"])
    gone = deletes.where("op = 'delete'")
    made = deletes.where("op = 'create'").select("obj_id", "seq", F.lit(CREATED).alias("type"), F.col("typ").alias("typ_id"))
    known = graph.objects()
    lost = gone.join(known.select("obj_id"), "obj_id", "left_semi").select("obj_id", "seq", F.lit(DELETED).alias("type"), F.col("typ").alias("typ_id"))
    sets = changes.where("op = 'set'").select("obj_id", F.col("field").alias("fld_id"), "seq", F.col("value").alias("new_value"))
    values = long_values(graph).join(sets.select("obj_id").distinct(), "obj_id", "left_semi")
    fields = field_events(sets.join(gone.select("obj_id"), "obj_id", "left_anti"), values)
    inverse = {(k, r.key): (r.inverse, r.side) for k in graph.catalog.entities for r in graph.catalog.refs(k).values()}
    pairs = changes.sparkSession.createDataFrame([(*k, *v) for k, v in inverse.items()] or [("", "", "", "")], "typ string, field string, fld_b string, side string")
    linked = changes.where(F.col("op").isin("link", "unlink")).join(F.broadcast(pairs), ["typ", "field"])  # as many rows as references in the catalog
    ends = [F.when(F.col("side") == "a", F.col(x)).otherwise(F.col(y)) for x, y in (("obj_id", "other"), ("field", "fld_b"), ("other", "obj_id"), ("fld_b", "field"))]
    linked = linked.select(*[e.alias(n) for e, n in zip(ends, EDGE)], "seq", (F.col("op") == "link").alias("added"))
    single = linked.where(F.col("obj_a").isNotNull() & F.col("obj_b").isNotNull())
    there = _edges_at(graph, linked)
    every = [_all_of(linked, edges, end) for edges in (there, single.where("added").select(*EDGE).distinct()) for end in ("obj_a", "obj_b")]
    linked = last_write(reduce(DataFrame.unionByName, [single, *every, *_edges_of_deleted(graph, gone)]), list(EDGE), ["seq"])
    # no event for an edge that is there already, or that isn't
    known_edges = reduce(DataFrame.unionByName, [there, *[e.select(*EDGE) for e in _edges_of_deleted(graph, gone)]]).distinct().withColumn("there", F.lit(True))
    linked = linked.join(known_edges, list(EDGE), "left").where(F.col("added") != F.coalesce("there", F.lit(False))).drop("there")
    parts = [made, lost, fields, edge_events(linked)]
    events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    events = events.withColumns({"commit_id": F.lit(commit_id).cast("long"), "ts": F.lit(ts.isoformat(sep=" ")).cast("timestamp_ntz"), "user_id": F.lit(user)})
    return events.select(*[c if c in events.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])


def commits(history: DataFrame, most: int | None = None) -> DataFrame:
    """(commit_id, ts, user_id, n_events) in order of ids."""
    out = history.groupBy("commit_id").agg(F.min("ts").alias("ts"), F.min("user_id").alias("user_id"), F.count(F.lit(1)).alias("n_events")).orderBy("commit_id")
    return out if most is None else out.limit(most)


def commits_of(history: DataFrame, obj_id) -> DataFrame:
    return history.where(F.col("obj_id") == F.lit(obj_id)).select("commit_id").distinct()


def commit(history: DataFrame, commit_id: int) -> DataFrame:
    """(obj_id, events) of one commit, events in order."""
    event = F.struct("seq", *[c for c in COLUMNS if c in history.columns and c not in ("commit_id", "ts", "user_id", "obj_id", "seq")])
    return history.where(F.col("commit_id") == F.lit(commit_id)).groupBy("obj_id").agg(F.array_sort(F.collect_list(event)).alias("events"))


def as_of(history: DataFrame, commit_id: int) -> DataFrame:
    """(obj_id, fld_id, value) of the fields that are set after a commit, by replay of the log. A delete unsets all fields of its object; what is set after it, on an object made anew, counts."""
    log = history.where(F.col("commit_id") <= F.lit(commit_id)).where(F.col("type").isin(CHANGED, DELETED)).select("obj_id", "type", "fld_id", "commit_id", "seq", "new_value")
    at = F.struct("commit_id", "seq")
    last = last_write(log.where(F.col("type") == CHANGED), ["obj_id", "fld_id"], ["commit_id", "seq"]).where(F.col("new_value").isNotNull())
    gone = log.where(F.col("type") == DELETED).groupBy("obj_id").agg(F.max(at).alias("gone"))
    last = last.join(gone, "obj_id", "left").where(F.col("gone").isNull() | (at > F.col("gone")))
    return last.select("obj_id", "fld_id", F.col("new_value").alias("value"))
