"""Models as JSON dumps of their definitions: the same format as other objects, with entities, fields and references as objects."""

from __future__ import annotations

import json
from typing import Any

from ..functions.types import Cardinality, DataType
from ..plans.catalog import Catalog, EntityDef, FieldDef, Model, RefDef
from ..plans.meta import BASE, BASE_ID, DEFINITIONS, META, META_ID


def _ids(x: Any) -> list[str]:
    return [i.lower() for i in ([x] if isinstance(x, str) else x or [])]


def load_model(text: str, *known: Model) -> Catalog:
    """The catalog of a dumped model. Without imports it gets the base model; definitions are small, so this is driver work.

    An edge has the name of its two references, the smaller id first, whose side is `a`; a reference without an
    inverse has an edge of its own. Fields of entities of imported models are added to those.
    """
    dump = json.loads(text)
    objects = {i.lower(): o for i, o in dump["entities"].items()}
    kinds = {v: k for k, v in DEFINITIONS.items()}
    of = lambda kind: {i: o for i, o in objects.items() if kinds.get(str(o.get("$type", "")).lower(), o.get("$type")) == kind}
    entities, enums, refs = of("EntityDefinition"), of("EnumDefinition"), of("ReferenceFieldDefinition")
    named = {i: o["Key"] for i, o in entities.items()} | {e.id: e.key for m in (BASE, *known) for e in m.entities if e.id}
    owner = lambda o: _ids(o.get("OwningEntity"))[0]

    def field(i: str, o: dict) -> FieldDef:
        enum = enums.get((_ids(o.get("Enum")) or [""])[0], {})
        return FieldDef(o["Key"], DataType(o["DataType"]), i, o.get("Name", ""), bool(o.get("IsIndexed")), tuple(v.strip() for v in enum.get("Variants", "").split(",") if v.strip()))

    def ref(i: str, o: dict) -> RefDef:
        other = (_ids(o.get("OtherReferenceFields")) or [i])[0]
        far = refs.get(other, o)
        first, last = sorted(((i, o), (other, far)), key=lambda x: x[0])
        name = f"{named[owner(first[1])]}.{first[1]['Key']}-{named[owner(last[1])]}.{last[1]['Key']}"
        return RefDef(o["Key"], named[owner(far)], far["Key"], Cardinality(o["RefType"]), name, "a" if i == first[0] else "b", i, o.get("Name", ""))

    parts: dict[str, tuple[list, list]] = {}
    for i, o in of("FieldDefinition").items():
        parts.setdefault(owner(o), ([], []))[0].append(field(i, o))
    for i, o in refs.items():
        parts.setdefault(owner(o), ([], []))[1].append(ref(i, o))
    defined = []
    for i in dict.fromkeys([*entities, *parts]):
        o, (fields, links) = entities.get(i, {}), parts.get(i, ([], []))
        parent = _ids(o.get("Parent"))
        defined.append(EntityDef(named[i], named[parent[0]] if parent else None, tuple(fields), tuple(links), i, o.get("Name", "")))
    model_id = dump["modelGuid"].lower()
    name = of("Model").get(model_id, {}).get("Name", model_id)
    imports = tuple(_ids(dump.get("importedModels"))) or (() if model_id in (META_ID, BASE_ID) else (BASE_ID,))
    return Catalog(Model(name, tuple(defined), imports, model_id), (META, BASE, *known))
