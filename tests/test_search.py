import datetime as dt

import pytest
from models import FOLDERS, ITEMS, build, dec, ids

from graphloom.operators.search import search
from graphloom.plans.catalog import Catalog, CatalogError, EntityDef, FieldDef, Model, UnknownFieldError
from graphloom.plans.criteria import Assoc, AssocMatch, Boolean, Equals, Multi, ObjectId, Range, Text, TextMatch, Typed, all_of, any_of, one_of

F = "TestingFolder"


@pytest.fixture(scope="module")
def folders(spark):
    objects = {
        "a": (F, {"Name": "Barbapapa Ba", "TestIntegerField": 14, "TestDecimalField": dec("14"), "TestDateField": dt.datetime(2000, 9, 12), "Kind": 0}),
        "b": (F, {"Name": "Foooooo", "TestIntegerField": 15, "TestDecimalField": dec("15"), "TestDateField": dt.datetime(2000, 9, 13), "TestBoolField": True, "Kind": 1}),
        "c": (F, {"Name": "Barbapapa", "TestIntegerField": 17, "TestDecimalField": dec("17"), "TestDateField": dt.datetime(2000, 9, 13, 8)}),
        "d": (F, {"Name": "Firefox :)", "TestIntegerField": 20, "TestDecimalField": dec("20.5"), "TestDateField": dt.datetime(2000, 9, 14), "TestBoolField": False, "Ref": "ab-1"}),
        "e": (F, {}),
        "f": ("TestingDocument", {}),
    }
    return build(spark, FOLDERS, objects, [(F, "b", "Parent", "a"), (F, "c", "Parent", "a"), (F, "d", "Parent", "b")])


CASES = [
    (Text("Name", "barbaPAPA", TextMatch.EXACT), "c"),
    (Text("Name", "", TextMatch.EXACT), "e"),
    (Text("Name", "oooo"), "b"),
    (Text("Name", "x"), "d"),
    (Text("Name", "barba", TextMatch.PREFIX), "ac"),
    (Text("Name", "PAPA", TextMatch.POSTFIX), "c"),
    (Text("Name", "firfo", TextMatch.FUZZY, 0.3), "d"),
    (Text("Name", "fi", TextMatch.FUZZY), ""),
    (Text("Name", "", TextMatch.PREFIX), "abcd"),
    (Range("TestIntegerField", 15, 20), "bcd"),
    (Range("TestIntegerField", 0, 0), "e"),
    (Range("TestIntegerField"), "e"),
    (Range("TestIntegerField", -5, 14), "ae"),
    (Range("TestDecimalField", dec("15"), dec("20")), "bc"),
    (Range("TestDecimalField", dec(0), dec(0)), "e"),
    (Range("TestDateField", dt.datetime(2000, 9, 13), dt.datetime(2000, 9, 13, 23, 59, 59, 999999)), "bc"),
    (Range("TestDateField", dt.datetime(1, 1, 1), dt.datetime(1, 1, 1)), "e"),
    (Boolean("TestBoolField", True), "b"),
    (Boolean("TestBoolField", False), "acde"),
    (Equals("Kind", "Secret"), "b"),
    (Equals("Ref", "AB-1"), "d"),
    (ObjectId("c"), "c"),
    (Assoc("Parent", ObjectId("a")), "bc"),
    (Assoc("Subfolders", ObjectId("b")), "a"),
    (Assoc("Subfolders", Text("Name", "o")), "ab"),
    (Assoc("Parent", match=AssocMatch.NULL), "ae"),
    (Assoc("Parent", match=AssocMatch.NOT_NULL), "bcd"),
    (Assoc("Subfolders", match=AssocMatch.NULL), "cde"),
    (Assoc("Parent", Assoc("Parent", ObjectId("a"))), "d"),
    (all_of(Range("TestIntegerField", 15, 20), Assoc("Parent", Text("Name", "barba"))), "bc"),
    (all_of(Assoc("Parent", Text("Name", "barba")), Assoc("Subfolders", ObjectId("d"))), "b"),
    (any_of(ObjectId("e"), Assoc("Parent", ObjectId("b"))), "de"),
    (one_of(Text("Name", "barba"), Assoc("Parent", ObjectId("a")), ObjectId("e")), "abe"),
    (one_of(Text("Name", "a"), Text("Name", "barba")), ""),
    (all_of(any_of(ObjectId("a"), ObjectId("b")), one_of(ObjectId("b"), ObjectId("c"))), "b"),
    (Multi(()), ""),
    (None, "abcde"),
]


@pytest.mark.parametrize("criterion,expected", CASES, ids=[str(k) for k in range(len(CASES))])
def test_criteria(folders, criterion, expected):
    assert ids(search(folders, F, criterion)) == sorted(expected)


def test_order_of_children_does_not_matter(folders):
    a, b = Range("TestIntegerField", 15, 20), Assoc("Parent", ObjectId("a"))
    for combine in (all_of, any_of, one_of):
        assert ids(search(folders, F, combine(a, b))) == ids(search(folders, F, combine(b, a)))


def test_bag_limit_and_unknown_names(folders):
    assert ids(search(folders, F, Assoc("Subfolders"), multiplicity=True)) == ["a", "a", "b"]
    assert ids(search(folders, F, limit=2)) == ["a", "b"]
    assert len(ids(search(folders, F, limit=0))) == 1
    with pytest.raises(UnknownFieldError):
        search(folders, F, Text("Nope", "x"))
    with pytest.raises(UnknownFieldError):
        search(folders, F, Assoc("Nope"))
    with pytest.raises(CatalogError):
        search(folders, F, Boolean("Name", True))


def test_predicates_reach_the_scan(spark, folders, tmp_path):
    folders.tables[F].write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    stored = folders.with_tables({F: spark.read.parquet(str(tmp_path / "t"))})
    plan = search(stored, F, all_of(Range("TestIntegerField", 0, 5), Text("Name", "a"))).select("obj_id")._jdf.queryExecution().executedPlan().toString()
    assert "Or(And(GreaterThanOrEqual(TestIntegerField,0),LessThanOrEqual(TestIntegerField,5)),IsNull(TestIntegerField))" in plan
    assert "TestDateField" not in plan


@pytest.fixture(scope="module")
def items(spark):
    objects = {"g": ("Group", {"Name": "g"}), "i": ("BaseItem", {"BaseName": "x"}), "j": ("ChildItem", {"BaseName": "x", "ChildValue": 41}), "k": ("GrandChildItem", {"BaseName": "y", "ChildValue": 42, "GrandChildFlag": True})}
    return build(spark, ITEMS, objects, [("BaseItem", k, "Group", "g") for k in "ijk"])


def test_inheritance(items):
    assert ids(items.scan("BaseItem")) == ["i", "j", "k"] and ids(items.scan("BaseItem", exact=True)) == ["i"]
    assert ids(search(items, "BaseItem", Text("BaseName", "x", TextMatch.EXACT))) == ["i", "j"]
    assert ids(search(items, "ChildItem", Range("ChildValue", 42, 42))) == ["k"]
    assert ids(search(items, "BaseItem", Range("ChildValue", 0, 0))) == []  # not of that type, so no default either
    assert ids(search(items, "BaseItem", Typed("ChildItem", Text("BaseName", "x")))) == ["j"]
    assert ids(items.downcast(items.scan("BaseItem"), "GrandChildItem")) == ["k"]
    assert items.upcast(items.scan("ChildItem"), "BaseItem").columns == ["obj_id", "_typ", "BaseName"]
    assert {r._typ for r in items.scan("ChildItem").collect()} == {"ChildItem", "GrandChildItem"}


def test_associations(items):
    groups = items.scan("Group")
    assert [(r.obj_id, r.n) for r in items.degree(groups, "Group", "Items").collect()] == [("g", 3)]
    assert [(r.obj_id, r.target) for r in items.single(groups, "Group", "Items").collect()] == [("g", "i")]
    assert items.collected(groups, "Group", "Items", 2).first().shown == "i, j and 1 more"
    assert items.contains("g", "Group", "Items", "k") and not items.contains("g", "Group", "Items", "z")


def test_catalog():
    c = ITEMS
    assert c.assignable("BaseItem", "GrandChildItem") and not c.assignable("ChildItem", "BaseItem") and not c.assignable("", "BaseItem")
    assert list(c.fields("GrandChildItem")) == ["BaseName", "ChildValue", "GrandChildFlag"]
    assert c.entity("group").key == "Group"
    f = (FieldDef("x", FOLDERS.field(F, "Name").type),)
    with pytest.raises(CatalogError, match="twice"):
        Catalog(Model("m", (EntityDef("A", None, f), EntityDef("B", "A", f))))
    with pytest.raises(CatalogError, match="itself"):
        Catalog(Model("m", (EntityDef("A", "B"), EntityDef("B", "A"))))
    a, b = Model("a", (EntityDef("A"),), ("b", "c")), Model("b", (EntityDef("B"),), ("c",))
    assert sorted(Catalog(a, (b, Model("c", (EntityDef("C"),)))).entities) == ["A", "B", "C"]  # c is reached twice


def test_ranges_between_the_values_of_a_type(spark):
    """A bound that a type can't hold doesn't round into the range."""
    g = build(spark, FOLDERS, {k: ("TestingFolder", {"TestIntegerField": n, "TestDecimalField": d}) for k, n, d in (("a", 10, dec("1.000000001")), ("b", 11, dec("-2")), ("c", None, None), ("d", 2**63 - 1, dec("10000000000000000000000000000")))})
    found = lambda f, low, high: ids(search(g, "TestingFolder", Range(f, low, high)))
    assert found("TestIntegerField", 10.5, 10.9) == [] and found("TestIntegerField", 9.5, 10.5) == ["a"] and found("TestIntegerField", -0.5, 0.5) == ["c"]
    assert found("TestIntegerField", 10.2, 10**30) == ["b", "d"] and found("TestIntegerField", 10**25, 10**30) == [] and found("TestIntegerField", 12, 10) == []
    assert found("TestDecimalField", dec("1.0000000011"), dec("1.0000000019")) == [] and found("TestDecimalField", dec("1.0000000001"), dec("1.0000000019")) == ["a"]
    assert found("TestDecimalField", -(10**40), dec("-1.5")) == ["b"] and found("TestDecimalField", 10**27, 10**60) == ["d"]
