"""Criteria compiled to DataFrame plans: scalars to one column predicate, associations to semi-, anti- and existence joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import matching as M
from ..functions.types import DEFAULTS, DataType, decode
from ..plans.catalog import CatalogError
from ..plans.criteria import Assoc, AssocMatch, Boolean, Combine, Criterion, Equals, Multi, ObjectId, Range, Text, TextMatch, Typed
from .store import Graph

_TEXT = {TextMatch.EXACT: M.equals_text, TextMatch.PREFIX: M.starts_with, TextMatch.POSTFIX: M.ends_with, TextMatch.SUBSTRING: M.contains}
_RANGES = (DataType.INTEGER, DataType.DECIMAL, DataType.DATETIME)


def search(graph: Graph, entity: str, criterion: Criterion | None = None, limit: int | None = None, multiplicity: bool = False) -> DataFrame:
    """Objects of a type that meet a criterion, as rows with all their columns and _typ, in no order.

    A limit gives the smallest ids (of 0 too it gives one row). With `multiplicity`, an association at the top gives a
    row for each neighbour that matches.
    """
    rows = graph.scan(entity)
    if criterion is not None:
        if multiplicity and isinstance(criterion, Assoc) and criterion.match is AssocMatch.SUBQUERY:
            ref = graph.catalog.ref(entity, criterion.ref)
            rows = graph.sources(entity, ref, _targets(graph, ref.target, criterion), rows, "inner")
        else:
            rows = _matching(graph, entity, criterion, rows)
    return rows if limit is None else rows.orderBy("obj_id").limit(max(1, limit))


def _targets(graph: Graph, entity: str, c: Assoc) -> DataFrame | None:
    """Neighbours that meet the inner criterion; None: any neighbour."""
    return None if c.criterion is None else _matching(graph, entity, c.criterion, graph.scan(entity))


def _scalar(graph: Graph, entity: str, c: Criterion) -> Column | None:
    """A criterion without associations as a predicate that is never null, else None."""
    if isinstance(c, Assoc):
        return None
    if isinstance(c, ObjectId):
        return F.col("obj_id").eqNullSafe(F.lit(c.value))
    if isinstance(c, Typed):
        own = graph.types_of(c.entity) if not graph.catalog.assignable(c.entity, entity) else F.lit(True)
        inner = F.lit(True) if c.criterion is None else _scalar(graph, graph.catalog.entity(c.entity).key, c.criterion)
        return None if inner is None else own & inner
    if isinstance(c, Multi):
        parts = [_scalar(graph, entity, x) for x in c.criteria]
        return None if any(p is None for p in parts) else _combined(c.combine, parts)
    owner = graph.catalog.owner_of(entity, c.field)
    leaf = _leaf(graph, entity, c)
    return leaf if graph.catalog.assignable(owner, entity) else graph.types_of(owner) & leaf


def _leaf(graph: Graph, entity: str, c: Criterion) -> Column:
    field = graph.catalog.field(entity, c.field)
    column = F.col(field.key)
    if isinstance(c, Range) and field.type in _RANGES:
        default = DEFAULTS[field.type]
        return M.between(column, field.spark, default if c.low is None else c.low, default if c.high is None else c.high, default)
    if isinstance(c, Boolean) and field.type is DataType.BOOLEAN:
        return M.is_boolean(column, c.value)
    if isinstance(c, Text) and field.type is DataType.STRING:
        return M.fuzzy(column, c.value, c.cutoff) if c.match is TextMatch.FUZZY else _TEXT[c.match](column, c.value)
    if isinstance(c, Equals) and field.type in (DataType.ENUM, DataType.GUID):
        value = decode(c.value, field.type, field.variants) if isinstance(c.value, str) else c.value
        return column.eqNullSafe(F.lit(value))
    raise CatalogError(f"{type(c).__name__} doesn't apply to field '{c.field}' of type {field.type.value}")


def _combined(combine: Combine, parts: list[Column]) -> Column:
    if not parts:
        return F.lit(False)
    if combine is Combine.XOR:
        return sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts), F.lit(0)) == 1
    return reduce(lambda a, b: a & b if combine is Combine.AND else a | b, parts)


def _matching(graph: Graph, entity: str, c: Criterion, rows: DataFrame) -> DataFrame:
    """Those of rows (objects of `entity`) that meet the criterion."""
    scalar = _scalar(graph, entity, c)
    if scalar is not None:
        return rows.where(scalar)
    if isinstance(c, Typed):
        return _matching(graph, graph.catalog.entity(c.entity).key, c.criterion, rows.where(graph.types_of(c.entity)))
    if isinstance(c, Assoc):
        ref = graph.catalog.ref(entity, c.ref)
        if c.match is AssocMatch.SUBQUERY:
            return graph.sources(entity, ref, _targets(graph, ref.target, c), rows)
        return graph.sources(entity, ref, None, rows, "left_anti" if c.match is AssocMatch.NULL else "left_semi")
    if c.combine is Combine.AND:  # columns first, so that they reach the scan; then one join for each association
        columns = [s for x in c.criteria if (s := _scalar(graph, entity, x)) is not None]
        rows = rows.where(_combined(Combine.AND, columns)) if columns else rows
        return reduce(lambda r, x: _matching(graph, entity, x, r), [x for x in c.criteria if _scalar(graph, entity, x) is None], rows)
    # one existence join for each child with an association
    parts, marked = [], rows
    for k, x in enumerate(c.criteria):
        s = _scalar(graph, entity, x)
        if s is None:
            ids = _ids(graph, entity, x).select(F.col("obj_id").alias(f"_i{k}")).distinct().withColumn(f"_m{k}", F.lit(True))
            marked = marked.join(ids, F.col("obj_id") == F.col(f"_i{k}"), "left")
            s = F.col(f"_m{k}").isNotNull()
        parts.append(s)
    return marked.where(_combined(c.combine, parts)).select(*rows.columns)


def _ids(graph: Graph, entity: str, c: Criterion) -> DataFrame:
    """Ids of the objects that meet a criterion; an association's come from its edges without a scan of the entity."""
    if isinstance(c, Assoc) and c.match is not AssocMatch.NULL:
        ref = graph.catalog.ref(entity, c.ref)
        return graph.ids_of_sources(entity, ref, _targets(graph, ref.target, c) if c.match is AssocMatch.SUBQUERY else None)
    return _matching(graph, entity, c, graph.scan(entity)).select("obj_id")


def gram_index(graph: Graph, entity: str, field: str) -> DataFrame:
    """(obj_id, gram): the distinct trigrams of a text field in lower case, for joins with terms that arrive as a table."""
    text = graph.scan(entity).select("obj_id", F.lower(graph.catalog.field(entity, field).key).alias("t")).where(F.length("t") >= 3)
    pieces = F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring("t", i, F.lit(3)))
    return text.select("obj_id", F.explode(F.array_distinct(pieces)).alias("gram"))
