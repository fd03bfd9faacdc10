import json

from models import empty

from graphloom.functions.types import Cardinality, DataType
from graphloom.operators.search import search
from graphloom.plans.criteria import Assoc, Equals
from graphloom.plans.meta import DEFINITIONS as D
from graphloom.plans.meta import USER_ID
from graphloom.sources import json_dump
from graphloom.sources.model_dump import load_model

MODEL = {
    "modelGuid": "M",
    "entities": {
        "m": {"$type": D["Model"].upper(), "Name": "Tasks"},
        "t": {"$type": D["EntityDefinition"], "Key": "Task", "Name": "Task", "Model": "m"},
        "s": {"$type": D["EntityDefinition"], "Key": "SubTask", "Parent": "t"},
        "f1": {"$type": D["FieldDefinition"], "Key": "State", "DataType": "Enum", "Enum": "e", "OwningEntity": "t"},
        "f2": {"$type": D["FieldDefinition"], "Key": "Mail", "DataType": "String", "IsIndexed": True, "OwningEntity": USER_ID.upper()},
        "e": {"$type": D["EnumDefinition"], "Name": "State", "Variants": "Open, Done"},
        "r1": {"$type": D["ReferenceFieldDefinition"], "Key": "Owner", "RefType": "SingleOptional", "OwningEntity": "t", "OtherReferenceFields": "r2"},
        "r2": {"$type": D["ReferenceFieldDefinition"], "Key": "Tasks", "RefType": "Multiple", "OwningEntity": USER_ID, "OtherReferenceFields": "r1"},
    },
}


def test_definitions():
    c = load_model(json.dumps(MODEL))
    assert c.model.name == "Tasks" and {m.name for m in c.models} == {"Tasks", "BaseModel", "MetaModel"}
    assert c.descendants("Task") == ["Task", "SubTask"] and c.field("SubTask", "State").variants == ("Open", "Done")
    assert c.field("User", "Mail").type is DataType.STRING and c.field("User", "Mail").indexed
    owner, tasks = c.ref("Task", "Owner"), c.ref("User", "Tasks")
    assert (owner.target, owner.cardinality, tasks.target) == ("User", Cardinality.OPTIONAL, "Task")
    assert owner.edge == tasks.edge and {owner.side, tasks.side} == {"a", "b"}


def test_data_of_a_loaded_model(spark):
    c = load_model(json.dumps(MODEL))
    g = json_dump.load(spark, json.dumps({"entities": {"1": {"$type": "t", "State": "Done", "Owner": "9"}, "2": {"$type": "SubTask", "State": "Open"}, "9": {"$type": USER_ID, "Mail": "x", "Tasks": ["1", "2"]}}}), c)
    assert [r.obj_id for r in search(g, "Task", Equals("State", "Done")).collect()] == ["1"]
    assert sorted(r.obj_id for r in search(g, "Task", Assoc("Owner")).collect()) == ["1", "2"]
    assert empty(spark, c).scan("Task").count() == 0
