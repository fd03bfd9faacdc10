"""A graph: one table for each entity (or one for a tree of entities, with a type column), and edges.

Edges of a reference are an edge table (a, b), or a foreign key in the rows of one side; a
step over a foreign key needs no edge table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Catalog, CatalogError, RefDef

TYPE = "_typ"


@dataclass(frozen=True)
class ForeignKey:
    """The edges (a: obj_id of a row of `entity`, b: its column)."""

    entity: str
    column: str


@dataclass(frozen=True)
class Graph:
    catalog: Catalog
    tables: dict[str, DataFrame]
    edges: dict[str, DataFrame | ForeignKey] = field(default_factory=dict)

    # scans

    def scan(self, entity: str, exact: bool = False) -> DataFrame:
        """All objects of an entity and of those that derive from it (or of it alone), with their type in _typ."""
        wanted = [self.catalog.entity(entity).key] if exact else self.catalog.descendants(entity)
        for e in self.catalog.lineage(entity):  # a table of a whole tree
            table = self.tables.get(e.key)
            if table is not None and TYPE in table.columns:
                tree = self.catalog.descendants(e.key)
                return table if set(tree) <= set(wanted) else table.where(F.col(TYPE).isin(wanted))
        parts = []
        for k in wanted:
            if k in self.tables:
                table = self.tables[k]
                parts.append(table.where(F.col(TYPE).isin(wanted)) if TYPE in table.columns else table.withColumn(TYPE, F.lit(k)))
        if not parts:
            raise CatalogError(f"no table holds objects of '{entity}'")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    def objects(self) -> DataFrame:
        """(obj_id, _typ) of every object."""
        tables = [t.select(F.col("obj_id").cast("string").alias("obj_id"), F.col(TYPE) if TYPE in t.columns else F.lit(k).alias(TYPE)) for k, t in self.tables.items()]
        return reduce(DataFrame.unionAll, tables)

    def lookup(self, entity: str, obj_id: Any) -> DataFrame:
        return self.scan(entity).where(F.col("obj_id") == F.lit(obj_id))

    def types_of(self, entity: str) -> Column:
        return F.col(TYPE).isin(self.catalog.descendants(entity))

    def downcast(self, rows: DataFrame, entity: str) -> DataFrame:
        """The rows that are of a derived entity, with all its columns."""
        return self.scan(entity).join(rows.select("obj_id"), "obj_id", "left_semi")

    def upcast(self, rows: DataFrame, entity: str) -> DataFrame:
        """Rows with the columns of a base entity alone."""
        return rows.select("obj_id", TYPE, *self.catalog.fields(entity))

    # associations

    def links(self, ref: RefDef) -> DataFrame:
        """(a, b): every edge seen from the reference's owner."""
        edge = self.edges[ref.edge]
        if isinstance(edge, ForeignKey):
            edge = self.scan(edge.entity).select(F.col("obj_id").alias("a"), F.col(edge.column).alias("b")).where(F.col("b").isNotNull())
        return edge.select("a", "b") if ref.side == "a" else edge.select(F.col("b").alias("a"), F.col("a").alias("b"))

    def sources(self, entity: str, ref: RefDef, targets: DataFrame | None, rows: DataFrame, how: str = "left_semi") -> DataFrame:
        """Those of `rows` (objects of `entity`) with an edge over ref to one of `targets` (any, if None); left_anti: those without; inner: one for each edge."""
        edge = self.edges[ref.edge]
        if isinstance(edge, ForeignKey) and ref.side == "a":
            key = F.col(edge.column)
            if targets is None:
                return rows.where(key.isNull() if how == "left_anti" else key.isNotNull())
            return rows.join(targets.select(F.col("obj_id").alias("_to")), key == F.col("_to"), how).select(*rows.columns)
        if isinstance(edge, ForeignKey):
            owners = self.scan(edge.entity) if targets is None else targets
            ids = owners.select(F.col(edge.column).alias("_id")).where(F.col("_id").isNotNull())
        else:
            ids = self.links(ref)
            if targets is not None:
                ids = ids.join(targets.select(F.col("obj_id").alias("_to")), F.col("b") == F.col("_to"), "left_semi")
            ids = ids.select(F.col("a").alias("_id"))
        return rows.join(ids, rows["obj_id"] == F.col("_id"), how).select(*rows.columns)

    def ids_of_sources(self, entity: str, ref: RefDef, targets: DataFrame | None) -> DataFrame:
        """(obj_id) of objects with such an edge, with repeats."""
        edge = self.edges[ref.edge]
        if isinstance(edge, ForeignKey) and ref.side == "b":
            owners = self.scan(edge.entity) if targets is None else targets
            return owners.select(F.col(edge.column).alias("obj_id")).where(F.col("obj_id").isNotNull())
        return self.sources(entity, ref, targets, self.scan(entity)).select("obj_id")

    def expand(self, rows: DataFrame, entity: str, ref_key: str) -> DataFrame:
        """(a, b) of every edge of rows over a reference."""
        return self.links(self.catalog.ref(entity, ref_key)).join(rows.select(F.col("obj_id").alias("a")), "a", "left_semi")

    def single(self, rows: DataFrame, entity: str, ref_key: str, mandatory: bool = False) -> DataFrame:
        """(obj_id, target): the smallest target of each row, null without one; `mandatory` leaves those rows out."""
        first = self.expand(rows, entity, ref_key).groupBy("a").agg(F.min("b").alias("target"))
        return rows.select("obj_id").join(first.withColumnRenamed("a", "obj_id"), "obj_id", "inner" if mandatory else "left")

    def degree(self, rows: DataFrame, entity: str, ref_key: str) -> DataFrame:
        """(obj_id, n): the number of targets of each row."""
        counts = self.expand(rows, entity, ref_key).groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        return rows.select("obj_id").join(counts.withColumnRenamed("a", "obj_id"), "obj_id", "left").select("obj_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

    def collected(self, rows: DataFrame, entity: str, ref_key: str, most: int = 3) -> DataFrame:
        """(obj_id, shown): the first targets of each row as `a, b and N more`. Only `most` ids of an object are gathered."""
        edges = self.expand(rows, entity, ref_key)
        ranked = edges.withColumn("k", F.expr("row_number() OVER (PARTITION BY a ORDER BY b)")).where(F.col("k") <= most)
        shown = ranked.groupBy("a").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("k", F.col("b").cast("string").alias("b")))), lambda x: x.b)).alias("shown"))
        more = edges.groupBy("a").agg((F.count(F.lit(1)) - most).alias("more"))
        text = F.when(F.col("more") > 0, F.concat("shown", F.lit(" and "), F.col("more").cast("string"), F.lit(" more"))).otherwise(F.col("shown"))
        joined = shown.join(more, "a").select(F.col("a").alias("obj_id"), text.alias("shown"))
        return rows.select("obj_id").join(joined, "obj_id", "left").select("obj_id", F.coalesce("shown", F.lit("")).alias("shown"))

    def contains(self, obj_id: Any, entity: str, ref_key: str, target: Any) -> bool:
        links = self.links(self.catalog.ref(entity, ref_key))
        return bool(links.where((F.col("a") == F.lit(obj_id)) & (F.col("b") == F.lit(target))).limit(1).count())

    def with_tables(self, tables: dict[str, DataFrame] | None = None, edges: dict[str, DataFrame | ForeignKey] | None = None) -> "Graph":
        return replace(self, tables=self.tables | (tables or {}), edges=self.edges | (edges or {}))
