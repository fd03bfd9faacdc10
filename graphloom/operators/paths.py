"""Path predicates as plans: from the last step back to the first, one semi-join each.

No step may look back at earlier ones, so the objects from which a path exists are found
set by set, from those that meet the last filter; paths are never listed, whatever the
fan-out. A repeat is the closure of its steps' pre-images, round by round, until no object
is new, which ends on cycles too.
"""

from __future__ import annotations

import decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import DataType, holds, literal
from ..plans.path_binding import CURRENT_USER, RIGHTS, Binding, bind, text_of
from ..plans.path_text import Call, CallTest, Current, FieldTest, Filtered, Hop, Logical, Node, Path, Predicate, Repeat, This, TypeTest, parse
from .lineage import checkpoint
from .store import Graph


class PathError(ValueError):
    pass


class Paths:
    """The predicates of a program over a graph, for one caller."""

    def __init__(self, graph: Graph, source: str, user: Any = None, min_hops: int = 1):
        program = parse(source)
        self.graph, self.user, self.min_hops = graph, user, min_hops
        self.binding: Binding = bind(graph.catalog, program)
        self.diagnostics = program.diagnostics + self.binding.diagnostics
        errors = [d for d in self.diagnostics if d.severity == "error"]
        if errors:
            raise PathError("; ".join(f"{d.line}:{d.column} {d.message}" for d in errors))
        self._known: dict[str, DataFrame] = {}
        self._open: list[str] = []

    def holds(self, name: str) -> DataFrame:
        """The objects for which a predicate holds, as rows of its input type; each predicate is planned once."""
        p = self.binding.predicates.get(name)
        if p is None:
            raise PathError(f"Unknown predicate '{name}'")
        if name in self._open:
            raise PathError(f"'{name}' calls itself")
        if name not in self._known:
            self._open.append(name)
            entity = self.binding.inputs[p]
            self._known[name] = self._expression(p.body, entity, self.graph.scan(entity))
            self._open.pop()
        return self._known[name]

    def evaluate(self, name: str, obj_id: Any) -> bool:
        """Whether a predicate holds for one object, which must be of its input type."""
        p: Predicate = self.binding.predicates[name]
        if not self.graph.lookup(self.binding.inputs[p], obj_id).limit(1).count():
            raise PathError(f"object {obj_id} is no '{self.binding.inputs[p]}'")
        return bool(self.holds(name).where(F.col("obj_id") == F.lit(obj_id)).limit(1).count())

    def _expression(self, n: Node, entity: str, rows: DataFrame) -> DataFrame:
        """Those of rows for which an expression holds."""
        if isinstance(n, (This, Current)):
            return rows
        if isinstance(n, Filtered):
            return self._where(n.where, entity, self._expression(n.source, entity, rows))
        if isinstance(n, Path):
            inner = self._expression(n.source, entity, rows)
            return self._before(n.steps, entity, None, inner)
        if isinstance(n, Call):
            return rows.join(self.holds(n.name.text).select("obj_id"), "obj_id", "left_semi").select(*rows.columns)
        if n.op == "And":
            return self._expression(n.right, entity, self._expression(n.left, entity, rows))
        left, right = (self._expression(x, entity, self.graph.scan(entity)).select("obj_id") for x in (n.left, n.right))
        return rows.join(left.union(right), "obj_id", "left_semi").select(*rows.columns)

    def _before(self, steps: tuple[Node, ...], entity: str, after: DataFrame | None, rows: DataFrame | None = None) -> DataFrame:
        """The objects (of `entity`, or of rows) from which the steps lead to one of `after`, or anywhere."""
        s, rest = steps[0], steps[1:]
        rows = self.graph.scan(entity) if rows is None else rows
        if isinstance(s, Hop):
            ref = self.binding.assocs[s]
            reached: DataFrame | None = after
            if rest:
                reached = self._before(rest, ref.target, after, self._where(s.where, ref.target, self.graph.scan(ref.target)))
            elif s.where is not None:
                at = self.graph.scan(ref.target) if after is None else after
                reached = self._where(s.where, ref.target, at)
            elif after is None and len(self.graph.catalog.descendants(ref.target)) < len(self.graph.catalog.descendants(self.graph.catalog.lineage(ref.target)[-1].key)):
                reached = self.graph.scan(ref.target)
            return self.graph.sources(entity, ref, reached, rows)
        ends = self._where(s.where, entity, self.graph.scan(entity))
        if rest:
            ends = self._before(rest, entity, after, ends)
        elif after is not None:
            ends = ends.join(after.select("obj_id"), "obj_id", "left_semi")
        return rows.join(self._closure(s, entity, ends), "obj_id", "left_semi").select(*rows.columns)

    def _closure(self, s: Repeat, entity: str, ends: DataFrame) -> DataFrame:
        """(obj_id) of the objects from which one or more rounds of the steps lead to `ends`."""
        new = checkpoint(ends.select("obj_id").distinct())
        layers = [new] if self.min_hops == 0 else []  # each is written once; only new objects are joined on
        while True:
            ids = self._before(s.steps, entity, self.graph.scan(entity).join(new, "obj_id", "left_semi")).select("obj_id").distinct()
            new = checkpoint(ids.join(reduce(DataFrame.union, layers), "obj_id", "left_anti") if layers else ids)
            if new.isEmpty():
                return reduce(DataFrame.union, layers) if layers else new
            layers.append(new)

    def _where(self, n: Node | None, entity: str, rows: DataFrame) -> DataFrame:
        """Those of rows that meet a condition: columns in one filter, calls as semi-joins, or marks under an OR."""
        if n is None:
            return rows
        if isinstance(n, Logical) and n.op == "And":
            return self._where(n.right, entity, self._where(n.left, entity, rows))
        columns = rows.columns
        marked, condition = self._condition(n, entity, rows)
        return marked.where(condition).select(*columns)

    def _condition(self, n: Node, entity: str, rows: DataFrame) -> tuple[DataFrame, Column]:
        """rows with marks, where needed, and the condition over them; it is never null."""
        if isinstance(n, Logical):
            rows, left = self._condition(n.left, entity, rows)
            rows, right = self._condition(n.right, entity, rows)
            return rows, left & right if n.op == "And" else left | right
        if isinstance(n, TypeTest):
            return rows, self.graph.types_of(self.binding.types[n])
        if isinstance(n, CallTest) or n.field.text in RIGHTS:
            name = n.name.text if isinstance(n, CallTest) else n.field.text
            mark = f"_c{len(rows.columns)}"
            ids = self.holds(name).select(F.col("obj_id").alias(f"{mark}i")).distinct().withColumn(mark, F.lit(True))
            rows = rows.join(ids, F.col("obj_id") == F.col(f"{mark}i"), "left")
            condition = F.col(mark).isNotNull() if self._asks_for_true(n) else F.col(mark).isNull()
            return rows, self._guarded(n, condition)
        if n.field.text == CURRENT_USER:
            same = F.col("obj_id").eqNullSafe(F.lit(self.user)) if self.user is not None else F.lit(False)
            return rows, self._guarded(n, same if self._asks_for_true(n) else ~same)
        return rows, self._guarded(n, self._compare(n))

    @staticmethod
    def _asks_for_true(n: Node) -> bool:
        return (n.value.raw == "true") == (n.op == "Equals")

    def _guarded(self, n: Node, condition: Column) -> Column:
        return self.graph.types_of(self.binding.types[n]) & condition if n in self.binding.types else condition

    def _compare(self, n: FieldTest) -> Column:
        """A missing value equals nothing and differs from everything; text is compared as it is."""
        f = self.binding.fields[n]
        if f.type is DataType.DATETIME:
            return F.lit(False)
        if n.value.kind == "String":
            text = text_of(n.value.raw)
            value = F.lit(f.variants.index(text) if f.type is DataType.ENUM and text in f.variants else text)
        elif n.value.kind == "Number" and not holds(decimal.Decimal(n.value.raw), f.spark):
            return F.lit(n.op != "Equals")  # no value of the field can be this one
        else:
            value = literal(n.value.raw == "true" if n.value.kind == "Bool" else decimal.Decimal(n.value.raw), f.spark)
        same = F.col(f.key).eqNullSafe(value)
        return same if n.op == "Equals" else ~same
