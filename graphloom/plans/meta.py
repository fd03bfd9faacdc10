"""The definitions that every model starts from: the meta-model's own entities and the base model with its users."""

from __future__ import annotations

from ..functions.types import Cardinality, DataType
from .catalog import Catalog, EntityDef, FieldDef, Model, RefDef

_S, _B = DataType.STRING, DataType.BOOLEAN
_MANY, _ONE = Cardinality.MANY, Cardinality.OPTIONAL


def _fields(*keys: str) -> tuple[FieldDef, ...]:
    return tuple(FieldDef(k, _S) for k in keys)


#: The ids of the two built-in models and of the type of users.
META_ID = "5270c4a5-71e0-4474-9f94-50745b29b404"
BASE_ID = "8f4d2969-355f-46a3-8892-d86980a80475"
USER_ID = "095433d0-4e74-471d-9b11-aea9538a86cc"

#: The ids of the types of definitions.
DEFINITIONS = {
    "Model": "5739ae0d-e179-4d46-bae2-081f99d699da",
    "EntityDefinition": "c15f876f-4f74-4034-9acb-03bc3b521e81",
    "FieldDefinition": "42a6f33d-a938-4ad8-9682-aabdc92a53d2",
    "ReferenceFieldDefinition": "2147ed0f-b37d-4429-a3f8-8312c1620383",
    "EnumDefinition": "9daec113-7ff2-4c52-8ba1-3d400ac39b7b",
}

META = Model(
    "MetaModel",
    (
        EntityDef("RootEntity"),
        EntityDef("Model", "RootEntity", _fields("Name"), (RefDef("EntityDefinitions", "EntityDefinition", "Model", _MANY, "model_entities"), RefDef("ImportedModels", "Model", "ImportedBy", _MANY, "imports"), RefDef("ImportedBy", "Model", "ImportedModels", _MANY, "imports", "b"))),
        EntityDef("EntityDefinition", "RootEntity", _fields("Key", "Name", "Id"), (RefDef("Model", "Model", "EntityDefinitions", _ONE, "model_entities", "b"), RefDef("Parent", "EntityDefinition", "Children", _ONE, "parents"), RefDef("Children", "EntityDefinition", "Parent", _MANY, "parents", "b"), RefDef("FieldDefinitions", "FieldDefinition", "OwningEntity", _MANY, "entity_fields"), RefDef("ReferenceFieldDefinitions", "ReferenceFieldDefinition", "OwningEntity", _MANY, "entity_refs"))),
        EntityDef("FieldDefinition", "RootEntity", (*_fields("Key", "Name", "Id", "DataType"), FieldDef("IsIndexed", _B)), (RefDef("OwningEntity", "EntityDefinition", "FieldDefinitions", _ONE, "entity_fields", "b"), RefDef("Enum", "EnumDefinition", "Fields", _ONE, "field_enums"))),
        EntityDef("ReferenceFieldDefinition", "RootEntity", _fields("Key", "Name", "Id", "RefType"), (RefDef("OwningEntity", "EntityDefinition", "ReferenceFieldDefinitions", _ONE, "entity_refs", "b"), RefDef("OtherReferenceFields", "ReferenceFieldDefinition", "OtherReferenceFields", _ONE, "inverses"))),
        EntityDef("EnumDefinition", "RootEntity", _fields("Name", "Variants"), (RefDef("Fields", "FieldDefinition", "Enum", _MANY, "field_enums", "b"),)),
    ),
    id=META_ID,
)

BASE = Model("BaseModel", (EntityDef("User", id=USER_ID),), imports=(META_ID,), id=BASE_ID)


def with_base(model: Model, *known: Model) -> Catalog:
    """The catalog of a model; one that names no import gets the base model."""
    if not model.imports and model.id not in (META_ID, BASE_ID):
        model = Model(model.name, model.entities, (BASE_ID,), model.id)
    return Catalog(model, (META, BASE, *known))
