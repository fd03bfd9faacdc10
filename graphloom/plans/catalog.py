"""Definitions of models: entities with single inheritance, fields and references."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.types import Cardinality, DataType, spark_type


class CatalogError(ValueError):
    pass


class UnknownFieldError(CatalogError):
    pass


@dataclass(frozen=True)
class FieldDef:
    key: str
    type: DataType
    id: str = ""
    name: str = ""
    indexed: bool = False
    variants: tuple[str, ...] = ()
    precision: int = 38
    scale: int = 9

    @property
    def spark(self) -> T.DataType:
        return spark_type(self.type, self.precision, self.scale)


@dataclass(frozen=True)
class RefDef:
    """A reference and where its edges are: in edge table `edge`, at its side `a` or `b`."""

    key: str
    target: str
    inverse: str
    cardinality: Cardinality = Cardinality.MANY
    edge: str = ""
    side: str = "a"
    id: str = ""
    name: str = ""


@dataclass(frozen=True)
class EntityDef:
    key: str
    parent: str | None = None
    fields: tuple[FieldDef, ...] = ()
    refs: tuple[RefDef, ...] = ()
    id: str = ""
    name: str = ""


@dataclass(frozen=True)
class Model:
    name: str
    entities: tuple[EntityDef, ...] = ()
    imports: tuple[str, ...] = ()
    id: str = ""


@dataclass
class Catalog:
    """A model and the models it imports, each once."""

    model: Model
    known: Iterable[Model] = ()
    entities: dict[str, EntityDef] = field(init=False)
    models: list[Model] = field(init=False)

    def __post_init__(self) -> None:
        known = {m.id or m.name: m for m in (*self.known, self.model)} | {m.name: m for m in (*self.known, self.model)}
        self.models, queue, seen = [], [self.model], set()
        while queue:
            m = queue.pop(0)
            if (m.id, m.name) in seen:
                continue
            seen.add((m.id, m.name))
            self.models.append(m)
            for i in m.imports:
                if i not in known:
                    raise CatalogError(f"unknown model {i}")
                queue.append(known[i])
        self.entities = {}
        for m in self.models:
            for e in m.entities:
                if e.key in self.entities:  # a model may add fields to an entity that it imports
                    old = self.entities[e.key]
                    e = EntityDef(e.key, old.parent or e.parent, old.fields + e.fields, old.refs + e.refs, old.id or e.id, old.name or e.name)
                self.entities[e.key] = e
        for key in self.entities:
            self.lineage(key)
            self.fields(key)

    def entity(self, key: str) -> EntityDef:
        """By key, of any case, or by id."""
        if key in self.entities:
            return self.entities[key]
        for e in self.entities.values():
            if e.key.lower() == key.lower() or e.id and e.id == key:
                return e
        raise CatalogError(f"Unknown type '{key}'")

    def lineage(self, key: str) -> list[EntityDef]:
        """The entity, its parent and so on."""
        out: list[EntityDef] = []
        current: str | None = key
        while current is not None:
            e = self.entity(current)
            if e in out:
                raise CatalogError(f"'{key}' inherits from itself")
            out.append(e)
            current = e.parent
        return out

    def descendants(self, key: str) -> list[str]:
        """The entity and all that derive from it."""
        base = self.entity(key).key
        return [k for k in self.entities if any(e.key == base for e in self.lineage(k))]

    def assignable(self, base: str | None, derived: str | None) -> bool:
        return bool(base and derived) and any(e.key == base for e in self.lineage(derived))

    def fields(self, key: str) -> dict[str, FieldDef]:
        """Own and inherited fields, those of the base first."""
        out: dict[str, FieldDef] = {}
        for e in reversed(self.lineage(key)):
            for f in e.fields:
                if f.key in out:
                    raise CatalogError(f"field '{f.key}' is defined twice in '{key}'")
                out[f.key] = f
        return out

    def refs(self, key: str) -> dict[str, RefDef]:
        return {r.key: r for e in reversed(self.lineage(key)) for r in e.refs}

    def owner_of(self, entity: str, field_key: str) -> str:
        """The entity of the lineage, or else below, that defines a field; the entity itself for its own columns."""
        for e in self.lineage(entity):
            if any(f.key == field_key for f in e.fields):
                return e.key
        for k in self.descendants(entity):
            if any(f.key == field_key for f in self.entities[k].fields):
                return k
        raise UnknownFieldError(f"Unknown field '{field_key}' on type '{entity}'")

    def field(self, entity: str, field_key: str) -> FieldDef:
        return next(f for f in self.entities[self.owner_of(entity, field_key)].fields if f.key == field_key)

    def ref(self, entity: str, key: str) -> RefDef:
        for k in (*[e.key for e in self.lineage(entity)], *self.descendants(entity)):
            for r in self.entities[k].refs:
                if r.key == key:
                    return r
        # the text is a fixed value
        raise UnknownFieldError(f"Unknown association '{key}' on type '{entity}'")

    def schema(self, key: str) -> T.StructType:
        """The columns of an entity's table: obj_id and all fields, missing values being null."""
        return T.StructType([T.StructField("obj_id", T.StringType(), False), *[T.StructField(f.key, f.spark, True, {"fld_id": f.id, "is_indexed": f.indexed, "variants": list(f.variants)}) for f in self.fields(key).values()]])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """All entities of the model and its imports by key: the definitions can be queried too."""
        rows = [(e.key, e.name or e.key, e.parent, m.name, len(e.fields), len(e.refs)) for m in self.models for e in m.entities]
        return spark.createDataFrame(rows, "key string, name string, parent string, model string, n_fields int, n_refs int").orderBy("key")
