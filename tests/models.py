"""Small models for the tests: folders, an inheritance chain, and a business model with rights."""

from decimal import Decimal

from graphloom.functions.types import Cardinality, DataType
from graphloom.operators.store import Graph
from graphloom.plans.catalog import Catalog, EntityDef, FieldDef, Model, RefDef

S, I, D, T, B, E, G = DataType.STRING, DataType.INTEGER, DataType.DECIMAL, DataType.DATETIME, DataType.BOOLEAN, DataType.ENUM, DataType.GUID
ONE, MANY = Cardinality.OPTIONAL, Cardinality.MANY


def fields(**kinds):
    return tuple(FieldDef(k, v) for k, v in kinds.items())


def pair(name, target, inverse, card=ONE):
    return RefDef(name, target, inverse, card, f"{name}-{inverse}", "a")


def back(name, target, inverse, card=MANY):
    return RefDef(name, target, inverse, card, f"{inverse}-{name}", "b")


FOLDERS = Catalog(Model("Test", (
    EntityDef("TestingFolder", None, fields(Name=S, TestDateField=T, TestDecimalField=D, TestIntegerField=I, TestBoolField=B) + (FieldDef("Kind", E, variants=("Plain", "Secret")), FieldDef("Ref", G)), (pair("Parent", "TestingFolder", "Subfolders"), back("Subfolders", "TestingFolder", "Parent")), id="a3ccbd8b-2256-414b-a402-1a091cb407a5"),
    EntityDef("TestingDocument"),
)))

ITEMS = Catalog(Model("Items", (
    EntityDef("Group", None, fields(Name=S), (back("Items", "BaseItem", "Group"),)),
    EntityDef("BaseItem", None, fields(BaseName=S), (pair("Group", "Group", "Items"),)),
    EntityDef("ChildItem", "BaseItem", fields(ChildValue=I)),
    EntityDef("GrandChildItem", "ChildItem", fields(GrandChildFlag=B)),
)))

BUSINESS = Catalog(Model("Business", (
    EntityDef("BusinessCase", None, fields(Title=S, Number=S, State=S, CreatedAt=T, Locked=B, IsArchived=B), (pair("OwnerUnit", "OrganizationalUnit", "BusinessCases"), pair("Owners", "User", "OwnedBusinessCases", MANY), back("Sessions", "Session", "BusinessCase"), back("Documents", "Document", "BusinessCase"))),
    EntityDef("Document", None, fields(Title=S, CreatedAt=T, State=S, Locked=B, FileName=S, FileSize=I), (pair("BusinessCase", "BusinessCase", "Documents"), pair("AgendaItems", "AgendaItem", "Documents", MANY), pair("Category", "DocumentCategory", "Documents"), pair("Folder", "Folder", "Documents"), pair("CreatedBy", "User", "CreatedDocuments"), pair("OwnerUnit", "OrganizationalUnit", "Documents"), pair("ExplicitViewers", "User", "ExplicitlyViewableDocuments", MANY))),
    EntityDef("PdfDocument", "Document", fields(PageCount=I)),
    EntityDef("OrganizationalUnit", None, fields(Name=S, Code=S), (pair("Parent", "OrganizationalUnit", "Children"), back("Children", "OrganizationalUnit", "Parent"), pair("Members", "User", "MemberOfUnits", MANY))),
    EntityDef("User", None, fields(UserName=S, Email=S, IsActive=B), (back("MemberOfUnits", "OrganizationalUnit", "Members"), back("CreatedDocuments", "Document", "CreatedBy"))),
    EntityDef("Session", None, fields(Title=S, IsPublic=B), (pair("BusinessCase", "BusinessCase", "Sessions"), back("AgendaItems", "AgendaItem", "Session"))),
    EntityDef("AgendaItem", None, fields(Title=S, Position=I, State=S, IsConfidential=B), (pair("Session", "Session", "AgendaItems"), back("Documents", "Document", "AgendaItems"))),
    EntityDef("DocumentCategory", None, fields(Key=S, Name=S, SortOrder=I, IsConfidentialDefault=B), (back("Documents", "Document", "Category"),)),
    EntityDef("Folder", None, fields(Name=S, Path=S, CreatedAt=T), (pair("Parent", "Folder", "Subfolders"), back("Subfolders", "Folder", "Parent"), back("Documents", "Document", "Folder"))),
)))


def empty(spark, catalog):
    edges = {r.edge for e in catalog.entities.values() for r in e.refs}
    return Graph(catalog, {k: spark.createDataFrame([], catalog.schema(k)) for k in catalog.entities}, {e: spark.createDataFrame([], "a string, b string") for e in edges})


def build(spark, catalog, objects, links=()):
    """objects: id -> (type, values); links: (type, id, ref, other)."""
    graph = empty(spark, catalog)
    tables, edges = {}, {}
    for key in catalog.entities:
        rows = [(i, *[v.get(f) for f in catalog.fields(key)]) for i, (kind, v) in objects.items() if kind == key]
        if rows:
            tables[key] = spark.createDataFrame(rows, catalog.schema(key)).coalesce(1)
    for kind, i, name, other in links:
        ref = catalog.ref(kind, name)
        edges.setdefault(ref.edge, []).append((i, other) if ref.side == "a" else (other, i))
    return graph.with_tables(tables, {n: spark.createDataFrame(e, "a string, b string").coalesce(1) for n, e in edges.items()})


def ids(frame):
    return sorted(r.obj_id for r in frame.select("obj_id").collect())


def dec(x):
    return Decimal(x)
