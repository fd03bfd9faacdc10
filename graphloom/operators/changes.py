"""Changes over an immutable graph: last write per key, overlays, cascading deletes, and sessions that collect and commit them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import CatalogError
from .lineage import checkpoint
from .store import TYPE, ForeignKey, Graph


def last_write(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of each key. One aggregation with a partial step, so that a hot key is reduced before it is shuffled."""
    rest = [c for c in changes.columns if c not in keys]
    kept = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
    return kept.select(*keys, *[F.col("_last").getField(c).alias(c) for c in rest]).select(*changes.columns)


def overlay(base: DataFrame, changes: DataFrame, keys: list[str], deleted: str = "deleted") -> DataFrame:
    """base as changes leave it: changed keys are hidden, and come back with their new rows unless deleted."""
    hidden = base.join(changes.select(*keys), keys, "left_anti").select(*base.columns)
    return hidden.unionByName(changes.where(~F.col(deleted)).select(*base.columns))


def seek(rows: DataFrame, key: str, start: Any, most: int) -> DataFrame:
    """The first rows at or behind a key, in its order, over a table or an overlay."""
    return rows.where(F.col(key) >= F.lit(start)).orderBy(key).limit(most)


def delete_objects(graph: Graph, entity: str, ids: DataFrame) -> Graph:
    """The graph without some objects (a frame with obj_id) of an entity or its descendants, and without edges at either end of them."""
    gone = ids.select("obj_id").distinct()
    tree = set(graph.catalog.descendants(entity))
    of_tree = lambda key: bool(tree & set(graph.catalog.descendants(key))) or any(e.key in tree for e in graph.catalog.lineage(key))
    tables = {}
    for key, table in graph.tables.items():
        if of_tree(key):
            if TYPE in table.columns:
                hit = table.where(F.col(TYPE).isin(list(tree))).join(gone, "obj_id", "left_semi").select("obj_id")
                tables[key] = table.join(hit, "obj_id", "left_anti").select(*table.columns)
            else:
                tables[key] = table.join(gone, "obj_id", "left_anti").select(*table.columns)
    edges: dict[str, DataFrame | ForeignKey] = {}
    after = graph.with_tables(tables)
    for name, edge in graph.edges.items():
        ends = {r.side: (owner, r) for owner in graph.catalog.entities for r in graph.catalog.entities[owner].refs if r.edge == name}
        cut = edge
        for side, (owner, ref) in ends.items():
            for end, key in ((side, owner), ("b" if side == "a" else "a", ref.target)):
                if not of_tree(key):
                    continue
                if isinstance(edge, ForeignKey):
                    if end == "b":  # the row stays, its reference goes
                        holder = next(t for t in (e.key for e in graph.catalog.lineage(edge.entity)) if t in after.tables)
                        table = after.tables[holder]
                        mark = gone.select(F.col("obj_id").alias("_gone"))
                        cleared = table.join(mark, F.col(edge.column) == F.col("_gone"), "left")
                        value = F.when(F.col("_gone").isNull(), F.col(edge.column))
                        after = after.with_tables({holder: cleared.withColumn(edge.column, value).select(*table.columns)})
                elif isinstance(cut, DataFrame):
                    cut = cut.join(gone.select(F.col("obj_id").alias(end)), end, "left_anti").select(*edge.columns)
        if cut is not edge:
            edges[name] = cut
    return after.with_tables(edges=edges)


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with more of them, each once."""
    return edges.unionByName(new.select(*edges.columns)).dropDuplicates()


def unlink(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those of `gone`, which names both ends or one."""
    on = [c for c in ("a", "b") if c in gone.columns]
    return edges.join(gone.select(*on), on, "left_anti").select(*edges.columns)


#: Rows of a session's frame up to which it is broadcast; larger ones are joined.
BROADCAST_ROWS = 10_000
#: Changes as rows. op: create, delete, set, link, unlink; value is JSON text of one scalar, other the far end of an edge.
CHANGES = T.StructType([T.StructField("seq", T.LongType(), False), *[T.StructField(n, T.StringType()) for n in ("op", "obj_id", "typ", "field", "value", "other")]])


def _holder(graph: Graph, typ: str) -> str:
    """The entity whose table holds objects of a type: its own, or that of the whole tree."""
    return next((e.key for e in graph.catalog.lineage(typ) if e.key in graph.tables and (e.key == typ or TYPE in graph.tables[e.key].columns)), typ)


def _later(seq: str, than: str) -> Column:
    return F.col(seq).isNotNull() & (F.col(than).isNull() | (F.col(seq) > F.col(than)))


def _with_values(graph: Graph, typ: str, changes: DataFrame) -> Graph:
    """The graph with what the changes (of one type) create and set. All of an object's changes come down to one row in one aggregation with a partial step."""
    holder = _holder(graph, typ)
    table = graph.tables.get(holder)
    table = changes.sparkSession.createDataFrame([], graph.catalog.schema(typ)) if table is None else table
    named = {r.field for r in changes.where("op = 'set'").select("field").distinct().collect()}  # as many as the type has fields
    if missing := named - {k for k in graph.catalog.fields(typ) if k in table.columns}:
        raise CatalogError(f"the table of '{holder}' has no column for {sorted(missing)}")
    fields = sorted(named)
    of = lambda op: F.max(F.when(F.col("op") == op, F.col("seq")))
    last = [F.max(F.when((F.col("op") == "set") & (F.col("field") == f), F.struct("seq", "value"))).alias(f"_x{i}") for i, f in enumerate(fields)]
    rows = changes.groupBy("obj_id").agg(of("delete").alias("_gone"), of("create").alias("_made"), *last)
    rows = rows.select("obj_id", _later("_made", "_gone").alias("_created"), *[F.when(_later(f"_x{i}.seq", "_gone"), F.col(f"_x{i}")).alias(f"_x{i}") for i in range(len(fields))])
    new = {f: F.col(f"_x{i}").getField("value").cast(table.schema[f].dataType) for i, f in enumerate(fields)}
    value = {f: F.when(F.col(f"_x{i}").isNotNull(), new[f]).otherwise(F.col(f)).alias(f) for i, f in enumerate(fields)}
    old = table.join(rows.drop("_created"), "obj_id", "left").select(*[value.get(c, F.col(c)) for c in table.columns])
    fresh = {f: c.alias(f) for f, c in new.items()} | {"obj_id": F.col("obj_id"), TYPE: F.lit(typ).alias(TYPE)}
    added = rows.where("_created").join(table.select("obj_id"), "obj_id", "left_anti")
    added = added.select(*[fresh[c] if c in fresh else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    return graph.with_tables({holder: old.unionByName(added)})


def _with_edges(graph: Graph, name: str, ops: DataFrame, gone: dict[str, DataFrame]) -> Graph:
    """The graph with links and unlinks (a, b, seq, there) of one reference; without b or a, all edges of the other end go. gone: the deletes (end, seq) of objects at either end."""
    table = graph.edges.get(name)
    if isinstance(table, ForeignKey):
        raise CatalogError(f"edges of '{name}' are a column; set the column instead")
    table = ops.select("a", "b").limit(0) if table is None else table
    pairs = ops.where("a IS NOT NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.max("seq").alias("seq"), F.max_by("there", "seq").alias("there"))
    new, kept = pairs.where("there"), table.select("a", "b").join(pairs, ["a", "b"], "left_anti")
    for end, other in (("a", "b"), ("b", "a")):
        ended = ops.where(F.col(other).isNull()).select(end, F.col("seq").alias("_end"))
        kept = kept.join(ended.select(end), end, "left_anti").select("a", "b")
        ended = ended.union(gone[end]) if end in gone else ended
        new = new.join(ended.groupBy(end).agg(F.max("_end").alias("_end")), end, "left").where(_later("seq", "_end")).drop("_end")
    return graph.with_tables(edges={name: kept.union(new.select("a", "b"))})


def apply_changes(graph: Graph, changes: DataFrame) -> Graph:
    """The graph as a frame of changes (CHANGES, each seq once) leaves it: what a session's apply gives, for any number of changes.

    Changes are written once and read again; each table and each edge table is joined with its own changes, by keys, and
    only types and names of fields and references, which the catalog bounds, come to the driver. Ids may repeat among
    entities of different trees. An unknown field or reference raises CatalogError; no changes leave the graph as it is.
    """
    catalog = graph.catalog
    changes = checkpoint(changes.select(*CHANGES.names))
    kinds = [tuple(r) for r in changes.select("typ", F.when(F.col("op").isin("link", "unlink"), F.col("field")).alias("ref"), (F.col("op") == "delete").alias("gone")).distinct().collect()]
    deleted = sorted({t for t, _, d in kinds if d})
    for typ in deleted:
        graph = delete_objects(graph, typ, changes.where((F.col("op") == "delete") & (F.col("typ") == typ)))
    for typ in sorted({t for t, r, d in kinds if r is None and not d}):
        graph = _with_values(graph, typ, changes.where((F.col("typ") == typ) & F.col("op").isin("create", "set", "delete")))
    named = {(t, r): catalog.ref(t, r) for t, r, _ in kinds if r is not None}
    for name in sorted({r.edge for r in named.values()}):
        ops, gone = [], {}
        for (typ, key), ref in named.items():
            if ref.edge == name:
                mine = changes.where((F.col("typ") == typ) & (F.col("field") == key) & F.col("op").isin("link", "unlink"))
                a, b = ("obj_id", "other") if ref.side == "a" else ("other", "obj_id")
                ops.append(mine.select(F.col(a).alias("a"), F.col(b).alias("b"), "seq", (F.col("op") == "link").alias("there")))
        for owner, entity in catalog.entities.items():
            for ref in entity.refs:
                kin = {*catalog.descendants(owner), *(e.key for e in catalog.lineage(owner))} & set(deleted) if ref.edge == name else set()
                if kin:
                    gone[ref.side] = changes.where((F.col("op") == "delete") & F.col("typ").isin(sorted(kin))).select(F.col("obj_id").alias(ref.side), F.col("seq").alias("_end"))
        graph = _with_edges(graph, name, reduce(DataFrame.union, ops), gone)
    return graph


@dataclass
class Session:
    """Collects single changes in the driver, as a caller types them, and commits them at once; bulk changes are a frame for apply_changes.

    Tables must have text ids and edges must be tables. Reads see one snapshot: `graph` before a commit, the
    returned one after it.
    """

    graph: Graph
    read_only: bool = False
    changes: list[tuple] = field(default_factory=list)

    def _add(self, op: str, obj_id: str, typ: str | None = None, name: str | None = None, value: Any = None, other: str | None = None) -> None:
        if self.read_only:
            raise PermissionError("the session is read-only")
        self.changes.append((len(self.changes), op, obj_id, typ, name, value, other))

    def create(self, entity: str, obj_id: str | None = None, **values: Any) -> str:
        obj_id = obj_id or str(uuid.uuid4())
        key = self.graph.catalog.entity(entity).key
        self._add("create", obj_id, key)
        for k, v in values.items():
            self.set(key, obj_id, k, v)
        return obj_id

    def delete(self, entity: str, obj_id: str) -> None:
        self._add("delete", obj_id, self.graph.catalog.entity(entity).key)

    def set(self, entity: str, obj_id: str, name: str, value: Any) -> None:
        """An empty text unsets the field, as None does."""
        self.graph.catalog.field(entity, name)
        self._add("set", obj_id, self.graph.catalog.entity(entity).key, name, None if value == "" else value)

    def link(self, entity: str, obj_id: str, ref: str, other: str, replace: bool = False) -> None:
        if replace:
            self.unlink(entity, obj_id, ref)
        self.graph.catalog.ref(entity, ref)
        self._add("link", obj_id, self.graph.catalog.entity(entity).key, ref, None, other)

    def unlink(self, entity: str, obj_id: str, ref: str, other: str | None = None) -> None:
        """One edge of a reference, or all of them."""
        self.graph.catalog.ref(entity, ref)
        self._add("unlink", obj_id, self.graph.catalog.entity(entity).key, ref, None, other)

    def missing_mandatory(self, entity: str) -> DataFrame:
        """(obj_id, ref) of objects without a target over a mandatory reference, after the changes."""
        after = self.apply()
        rows = after.scan(entity)
        out = None
        for r in after.catalog.refs(entity).values():
            if r.cardinality.value == "SingleMandatory":
                part = after.sources(entity, r, None, rows, "left_anti").select("obj_id", F.lit(r.key).alias("ref"))
                out = part if out is None else out.union(part)
        return rows.select("obj_id", F.lit("").alias("ref")).limit(0) if out is None else out

    def apply(self) -> Graph:
        """The graph as the changes leave it; the last write of a field or an edge counts, a delete removes both, and what is created after it starts empty. Columns that are no fields stay."""
        graph, spark = self.graph, next(iter(self.graph.tables.values())).sparkSession
        values: dict[str, dict[str, dict]] = {}
        created: dict[str, set[str]] = {}
        edges: dict[str, dict[tuple, bool]] = {}
        cleared: dict[str, list[tuple[str, str]]] = {}
        gone: dict[str, set[str]] = {}
        for _, op, obj, typ, name, value, other in self.changes:
            if op in ("create", "set"):
                values.setdefault(typ, {}).setdefault(obj, {})
                if op == "create":
                    created.setdefault(typ, set()).add(obj)
                else:
                    values[typ][obj][name] = value
            elif op == "delete":
                values.get(typ, {}).pop(obj, None)
                created.get(typ, set()).discard(obj)
                gone.setdefault(typ, set()).add(obj)
                for known in edges.values():
                    for k in [k for k in known if obj in k]:
                        known[k] = False
            else:
                ref = graph.catalog.ref(typ, name)
                known = edges.setdefault(ref.edge, {})
                pair = (obj, other) if ref.side == "a" else (other, obj)
                if other is not None:
                    known[pair] = op == "link"
                else:
                    cleared.setdefault(ref.edge, []).append((ref.side, obj))
                    for k in known:
                        if k[0 if ref.side == "a" else 1] == obj:
                            known[k] = False
        for typ, ids in gone.items():
            graph = delete_objects(graph, typ, spark.createDataFrame([(i,) for i in sorted(ids)], "obj_id string"))
        for typ, rows in values.items():
            holder = _holder(graph, typ)
            table = graph.tables.get(holder)
            table = spark.createDataFrame([], graph.catalog.schema(typ)) if table is None else table
            fields = {k: f for k, f in graph.catalog.fields(typ).items() if k in table.columns}
            if missing := {k for v in rows.values() for k in v if k not in fields}:
                raise CatalogError(f"the table of '{holder}' has no column for {sorted(missing)}")
            new = [(i, *[v.get(f) for f in fields]) for i, v in rows.items()]
            marks = [T.StructField(f"_set_{f}", T.BooleanType()) for f in fields]
            full = T.StructType([T.StructField("obj_id", T.StringType()), *[T.StructField(f"_new_{f}", fields[f].spark) for f in fields], *marks, T.StructField("_created", T.BooleanType())])
            made = created.get(typ, set())
            frame = spark.createDataFrame([(*n, *[f in rows[n[0]] for f in fields], n[0] in made) for n in new], full)
            frame = F.broadcast(frame) if len(new) <= BROADCAST_ROWS else frame
            value = {f: F.when(F.coalesce(f"_set_{f}", F.lit(False)), F.col(f"_new_{f}")).otherwise(F.col(f)).cast(table.schema[f].dataType).alias(f) for f in fields}
            old = table.join(frame, "obj_id", "left").select(*[value.get(c, F.col(c)) for c in table.columns])
            fresh = {f: F.col(f"_new_{f}").cast(table.schema[f].dataType).alias(f) for f in fields} | {"obj_id": F.col("obj_id"), TYPE: F.lit(typ).alias(TYPE)}
            added = frame.where("_created").join(table.select("obj_id"), "obj_id", "left_anti")
            added = added.select(*[fresh[c] if c in fresh else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in table.columns])
            graph = graph.with_tables({holder: old.unionByName(added)})
        for name in {*edges, *cleared}:
            table = graph.edges.get(name)
            if isinstance(table, ForeignKey):
                raise CatalogError(f"edges of '{name}' are a column; set the column instead")
            table = spark.createDataFrame([], "a string, b string") if table is None else table
            for side, obj in cleared.get(name, []):
                table = table.where(F.col("a" if side == "a" else "b") != obj)
            known = edges.get(name, {})
            if known:
                frame = spark.createDataFrame([(*k, v) for k, v in known.items()], "a string, b string, there boolean")
                frame = F.broadcast(frame) if len(known) <= BROADCAST_ROWS else frame
                table = table.join(frame, ["a", "b"], "left_anti").select("a", "b").union(frame.where("there").select("a", "b"))
            graph = graph.with_tables(edges={name: table})
        return graph

    def rows(self) -> DataFrame:
        """The changes as a frame, for the history."""
        spark = next(iter(self.graph.tables.values())).sparkSession
        return spark.createDataFrame([(s, o, i, t, n, None if v is None else str(v).lower() if isinstance(v, bool) else str(v), x) for s, o, i, t, n, v, x in self.changes], CHANGES)
