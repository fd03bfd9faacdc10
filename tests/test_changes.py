import datetime as dt
import json
import random

import pytest
from models import BUSINESS, FOLDERS, ITEMS, build, dec, empty, ids
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.functions.types import DataType, decode, encode
from graphloom.operators import history
from graphloom.operators.changes import CHANGES, Session, apply_changes, delete_objects, last_write, link, overlay, unlink
from graphloom.operators.search import search
from graphloom.operators.store import ForeignKey, Graph
from graphloom.plans.catalog import CatalogError
from graphloom.plans.criteria import Assoc, AssocMatch, Text
from graphloom.plans.meta import with_base
from graphloom.sources import json_dump, snapshots
from graphloom.streaming import commit_stream

K = "TestingFolder"


def test_last_write_and_overlay(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    changes = spark.createDataFrame([(0, 1, "x", False), (1, 1, "y", False), (2, 2, None, True), (3, 4, "n", False), (4, 3, "z", True), (5, 3, "w", False)], "seq int, k int, v string, deleted boolean")
    last = last_write(changes, ["k"], ["seq"])
    assert last.columns == changes.columns
    assert sorted((r.k, r.v) for r in overlay(base, last, ["k"]).collect()) == [(1, "y"), (3, "w"), (4, "n")]
    assert overlay(base, last.limit(0), ["k"]).count() == 3 and overlay(base.limit(0), last, ["k"]).count() == 3


def test_edges(spark):
    edges = spark.createDataFrame([("a", "b")], "a string, b string")
    more = spark.createDataFrame([("a", "b"), ("a", "c")], "a string, b string")
    both = link(edges, more)
    assert both.count() == 2 and unlink(both, more.select("a")).count() == 0 and unlink(both, edges).count() == 1


def test_delete_takes_edges_along(spark):
    g = build(spark, FOLDERS, {k: (K, {"Name": k}) for k in "abc"}, [(K, "b", "Parent", "a"), (K, "c", "Parent", "b")])
    after = delete_objects(g, K, spark.createDataFrame([("b",)], "obj_id string"))
    assert ids(after.scan(K)) == ["a", "c"]
    assert ids(search(after, K, Assoc("Parent", match=AssocMatch.NULL))) == ["a", "c"]
    assert ids(delete_objects(g, K, spark.createDataFrame([("nobody",)], "obj_id string")).scan(K)) == ["a", "b", "c"]


def test_session(spark):
    g = build(spark, FOLDERS, {"a": (K, {"Name": "old", "TestIntegerField": 3})})
    s = Session(g)
    s.set(K, "a", "Name", "first")
    s.set(K, "a", "Name", "last")
    s.set(K, "a", "TestIntegerField", None)
    b = s.create(K, Name="new")
    s.link(K, b, "Parent", "a")
    c = s.create(K, "c")
    s.delete(K, c)
    after = s.apply()
    assert [(r.Name, r.TestIntegerField) for r in after.lookup(K, "a").collect()] == [("last", None)]
    assert ids(after.scan(K)) == sorted(["a", b]) and ids(search(after, K, Assoc("Parent"))) == [b]
    assert ids(g.scan(K)) == ["a"]  # the snapshot before stays as it was
    t = Session(after)
    t.unlink(K, "a", "Subfolders")
    t.set(K, "a", "Name", "")
    assert ids(search(t.apply(), K, Assoc("Parent"))) == [] and ids(search(t.apply(), K, Text("Name", ""))) == [b]
    with pytest.raises(PermissionError):
        Session(g, read_only=True).delete(K, "a")


def events(spark, g, session):
    rows = history.commit_events(g, session.rows(), 1, dt.datetime(2026, 1, 1), "u").collect()
    return sorted((r.obj_id, r.type, r.fld_id or "", r.old_value, r.new_value, r.obj_b or "") for r in rows)


def test_history(spark):
    g = build(spark, FOLDERS, {"a": (K, {"Name": "old"}), "z": (K, {"Name": "z"})}, [(K, "z", "Parent", "a")])
    s = Session(g)
    s.set(K, "a", "Name", "mid")
    s.set(K, "a", "Name", "new")
    s.set(K, "a", "TestIntegerField", None)  # was unset before: no event
    b = s.create(K, "b", TestBoolField=True)
    s.link(K, b, "Parent", "a")
    assert events(spark, g, s) == [
        ("a", "AsoAdded", "Subfolders", None, None, "b"), ("a", "FldChanged", "Name", "old", "new", ""),
        ("b", "AsoAdded", "Parent", None, None, "a"), ("b", "FldChanged", "TestBoolField", None, "true", ""), ("b", "ObjCreated", "", None, None, ""),
    ]
    t = Session(g)
    t.set(K, "z", "Name", "noise")
    t.unlink(K, "z", "Parent", "a")
    t.delete(K, "z")
    assert events(spark, g, t) == [("a", "AsoRemoved", "Subfolders", None, None, "z"), ("z", "AsoRemoved", "Parent", None, None, "a"), ("z", "ObjDeleted", "", None, None, "")]
    u = Session(g)
    u.set(K, "a", "Name", None)
    assert events(spark, g, u) == [("a", "FldChanged", "Name", "old", None, "")]


def test_delete_logs_edges_that_were_there(spark):
    g = build(spark, FOLDERS, {k: (K, {"Name": k}) for k in "axyz"}, [(K, "z", "Parent", "a"), (K, "x", "Parent", "z"), (K, "y", "Parent", "a")])
    s = Session(g)
    s.unlink(K, "a", "Subfolders", "z")  # from the other end, and again by the delete: one removal
    s.delete(K, "z")
    assert [e for e in events(spark, g, s) if e[1] == "AsoRemoved"] == [("a", "AsoRemoved", "Subfolders", None, None, "z"), ("x", "AsoRemoved", "Parent", None, None, "z"), ("z", "AsoRemoved", "Parent", None, None, "a"), ("z", "AsoRemoved", "Subfolders", None, None, "x")]


def test_unlink_of_all_targets_and_links_that_are_there(spark):
    g = build(spark, FOLDERS, {k: (K, {"Name": k}) for k in "axyz"}, [(K, "x", "Parent", "a"), (K, "y", "Parent", "a")])
    s = Session(g)
    s.link(K, "x", "Parent", "a")  # there already
    s.link(K, "z", "Parent", "a")
    s.unlink(K, "y", "Parent", "z")  # not there
    s.unlink(K, "a", "Subfolders")  # all three
    s.link(K, "y", "Parent", "a")  # and one of them anew: nothing changes for it
    assert [e for e in events(spark, g, s)] == [("a", "AsoRemoved", "Subfolders", None, None, "x"), ("x", "AsoRemoved", "Parent", None, None, "a")]
    assert ids(search(s.apply(), K, Assoc("Parent"))) == ["y"]


def test_delete_then_create(spark):
    g = build(spark, FOLDERS, {"a": (K, {"Name": "old", "TestIntegerField": 3}), "b": (K, {})}, [(K, "b", "Parent", "a")])
    s = Session(g)
    s.delete(K, "a")
    s.create(K, "a", Name="new")
    after = s.apply()
    assert [(r.Name, r.TestIntegerField) for r in after.lookup(K, "a").collect()] == [("new", None)] and ids(search(after, K, Assoc("Parent"))) == []
    s.link(K, "b", "Parent", "a")
    assert ids(search(s.apply(), K, Assoc("Parent"))) == ["b"]
    log = spark.createDataFrame([(1, "a", 0, history.CHANGED, "f", "1"), (1, "b", 1, history.CHANGED, "f", "2"), (2, "a", 0, history.DELETED, None, None), (2, "a", 1, history.CHANGED, "g", "3"), (3, "b", 5, history.DELETED, None, None)], "commit_id long, obj_id string, seq long, type string, fld_id string, new_value string")
    at = lambda n: sorted(tuple(r) for r in history.as_of(log, n).collect())
    assert at(1) == [("a", "f", "1"), ("b", "f", "2")] and at(2) == [("a", "g", "3"), ("b", "f", "2")] and at(3) == [("a", "g", "3")]


def test_bulk_changes_do_what_a_session_does(spark):
    """The same random changes, one by one and as a frame."""
    r = random.Random(5)
    names = "abcdef"
    for _ in range(3):
        g = build(spark, FOLDERS, {k: (K, {"Name": k, "TestIntegerField": 1}) for k in "abcd"}, [(K, "b", "Parent", "a"), (K, "c", "Parent", "a"), (K, "d", "Parent", "c")])
        s = Session(g)
        for _ in range(30):
            x, y = r.choice(names), r.choice(names)
            op = r.choice(["create", "delete", "set", "set", "unset", "link", "link", "unlink", "clear", "children"])
            if op == "create":
                s.create(K, x, **({"Name": f"new-{x}"} if r.random() < 0.5 else {}))
            elif op == "delete":
                s.delete(K, x)
            elif op in ("set", "unset"):
                s.set(K, x, "TestIntegerField", r.randint(2, 9) if op == "set" else None)
            elif op in ("link", "unlink"):
                getattr(s, op)(K, x, "Parent", y)
            else:
                s.unlink(K, x, "Parent" if op == "clear" else "Subfolders")
        one, many = s.apply(), apply_changes(g, s.rows())
        rows = lambda a: sorted(tuple(x) for x in a.scan(K).select("obj_id", "Name", "TestIntegerField").fillna({"Name": "", "TestIntegerField": -1}).collect())
        links = lambda a: sorted(tuple(x) for x in a.links(FOLDERS.ref(K, "Parent")).collect())
        assert rows(one) == rows(many) and links(one) == links(many)
    assert rows(apply_changes(g, spark.createDataFrame([], CHANGES))) == rows(g)
    with pytest.raises(CatalogError):
        apply_changes(g, spark.createDataFrame([(0, "set", "a", K, "Nope", "1", None)], CHANGES))


def test_apply_keeps_what_it_does_not_know(spark):
    """Key columns and the type column of a tree's table stay, and rows made in it get their type."""
    tree = Graph(ITEMS, {"BaseItem": spark.createDataFrame([("a", "BaseItem", "x", None, "g"), ("b", "ChildItem", "y", 4, None)], "obj_id string, _typ string, BaseName string, ChildValue long, group string")}, {"Group-Items": ForeignKey("BaseItem", "group")})
    s = Session(tree)
    s.set("BaseItem", "a", "BaseName", "z")
    s.create("ChildItem", "c", ChildValue=7)
    after = s.apply()
    assert sorted(tuple(r) for r in after.tables["BaseItem"].collect()) == [("a", "BaseItem", "z", None, "g"), ("b", "ChildItem", "y", 4, None), ("c", "ChildItem", None, 7, None)]
    assert ids(after.scan("ChildItem")) == ["b", "c"] and [tuple(r) for r in after.links(ITEMS.ref("BaseItem", "Group")).collect()] == [("a", "g")]
    s.create("GrandChildItem", "d", GrandChildFlag=True)
    with pytest.raises(CatalogError):
        s.apply()


def test_a_save_that_ends_halfway(spark, tmp_path):
    path = str(tmp_path / "g")
    g = build(spark, FOLDERS, {"a": (K, {"Name": "old"})})
    log = spark.createDataFrame([(1, "a")], "commit_id long, obj_id string")
    assert snapshots.save(g, path, log) == 1
    with pytest.raises(Exception):
        snapshots.save(g.with_tables({"TestingDocument": g.tables[K].select(F.raise_error(F.lit("lost")).alias("obj_id"))}), path, log)
    assert snapshots.history(spark, path).count() == 1 and ids(snapshots.load(spark, path, FOLDERS).scan(K)) == ["a"]
    assert snapshots.save(g, path, log) == 2 and snapshots.history(spark, path).count() == 2 and snapshots.history(spark, path, 1).count() == 1


def test_show_lists_every_target(spark):
    children = [f"child-with-a-long-name-{k:03}" for k in range(70)]
    g = build(spark, FOLDERS, {k: (K, {"Name": "n" * 90}) for k in ["a", *children]}, [(K, c, "Parent", "a") for c in children])
    shown = list(cli.show_object(g, "a"))
    assert [tuple(x) for x in shown if x[0] == "Subfolders"] == [("Subfolders", f"{c} ({K})") for c in children]
    assert ("Parent", "") in shown and ("Name", "n" * 90) in shown


def test_commits(spark):
    ids_ = history.CommitIds()
    a, b = ids_.next(5.0), ids_.next(5.0)
    assert a == 5000 << 16 and b == a + 1 and ids_.next(6.0) == 6000 << 16
    rows = [(2, "x", 0, history.CHANGED, "f", "1"), (2, "y", 1, history.CHANGED, "f", "2"), (3, "x", 0, history.CHANGED, "f", None), (1, "x", 0, history.CREATED, None, None)]
    log = spark.createDataFrame(rows, "commit_id long, obj_id string, seq long, type string, fld_id string, new_value string").withColumns({"ts": F.current_timestamp(), "user_id": F.lit("u")})
    assert [r.commit_id for r in history.commits(log).collect()] == [1, 2, 3] and len(history.commits(log, 2).collect()) == 2
    assert sorted(r.commit_id for r in history.commits_of(log, "x").collect()) == [1, 2, 3]
    assert {r.obj_id: len(r.events) for r in history.commit(log, 2).collect()} == {"x": 1, "y": 1}
    assert sorted((r.obj_id, r.value) for r in history.as_of(log, 2).collect()) == [("x", "1"), ("y", "2")]
    assert [r.obj_id for r in history.as_of(log, 3).collect()] == ["y"]


def test_json_round_trip(spark):
    values = {"Name": 'q"uo\\te\n', "TestDateField": dt.datetime(2000, 9, 13, 8, 1, 2, 345678), "TestDecimalField": dec("12.500000001"), "TestIntegerField": 7, "TestBoolField": False, "Kind": 1, "Ref": "ab"}
    g = build(spark, FOLDERS, {"a": (K, values), "b": (K, {})}, [(K, "b", "Parent", "a")])
    text = json_dump.dump(g)
    body = json.loads(text)["entities"]
    assert body["b"] == {"$type": "a3ccbd8b-2256-414b-a402-1a091cb407a5", "Parent": "a"} and body["a"]["Subfolders"] == ["b"] and body["a"]["Kind"] == "Secret"
    back = json_dump.load(spark, text, FOLDERS)
    row = back.lookup(K, "a").first()
    assert {k: row[k] for k in values} == values
    assert [tuple(r) for r in back.edges["Parent-Subfolders"].collect()] == [("b", "a")]
    assert json_dump.load(spark, '{"entities": {}}', FOLDERS).scan(K).count() == 0


def test_json_kinds(spark):
    text = json.dumps({"entities": {"x": {"$type": "TestingFolder", "Name": 5, "TestIntegerField": "7", "TestBoolField": None, "Nope": 1, "TestDateField": "no date", "Parent": None}, "y": {"$type": "Unknown"}}})
    row = json_dump.load(spark, text, FOLDERS).lookup(K, "x").first()
    assert [row[k] for k in ("Name", "TestIntegerField", "TestBoolField", "TestDateField")] == [None] * 4


def test_snapshots_and_cli(spark, tmp_path, capsys):
    path = str(tmp_path / "g")
    base = ["--catalog", "models:FOLDERS", "--path", path]
    assert cli.main([*base, "db", "init"]) == 0
    cli.main([*base, "obj", "create", "--type", K, "--id", "a", "--set", "Name=First", "--set", "TestBoolField=1"])
    cli.main([*base, "obj", "create", "--type", K, "--id", "b", "--set", "Parent=a"])
    cli.main([*base, "obj", "update", "--type", K, "--id", "a", "--set", "Name="])
    capsys.readouterr()
    cli.main([*base, "obj", "show", "--id", "b"])
    cli.main([*base, "obj", "list", "--type", K])
    cli.main([*base, "types"])
    out = capsys.readouterr().out
    assert "a (TestingFolder)" in out and "TestingDocument" in out
    g = snapshots.load(spark, path, FOLDERS)
    assert g.lookup(K, "a").first().Name is None and snapshots.load(spark, path, FOLDERS, 2).lookup(K, "a").first().Name == "First"
    assert history.commits(snapshots.history(spark, path)).count() == 3
    dumped = str(tmp_path / "d.json")
    cli.main([*base, "db", "dump-json", dumped])
    assert set(json.load(open(dumped))["entities"]) == {"a", "b"}
    with pytest.raises(FileNotFoundError):
        snapshots.load(spark, str(tmp_path / "none"), FOLDERS)
    with pytest.raises(ValueError):
        snapshots.load(spark, path, BUSINESS)


def test_scalars_and_tables():
    assert decode("0", DataType.BOOLEAN) is False and decode("", DataType.STRING) is None and decode("1.50", DataType.DECIMAL) == dec("1.50")
    assert encode(dec("1.50"), DataType.DECIMAL) == "1.5" and encode(None, DataType.INTEGER) == "" and encode(1, DataType.ENUM, ("a", "b")) == "b"
    with pytest.raises(ValueError):
        decode("maybe", DataType.BOOLEAN)
    lines = cli.table(["k", "v"], [["a", "x" * 80]]).split("\n")
    assert len(lines[1]) == 3 + cli.WIDTH and lines[1].endswith("…")


def test_base_models(spark):
    c = with_base(FOLDERS.model)
    assert {"User", "EntityDefinition", K} <= set(c.entities)
    assert empty(spark, FOLDERS).objects().count() == 0
    assert [r.key for r in c.to_frame(spark).collect()] == sorted(c.entities)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", 1), (1, "a", 2), (2, "b", 3)], "seq int, k string, v int")
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = commit_stream(stream, ["k"], ["seq"], lambda batch, n: seen.extend((r.k, r.v) for r in batch.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [("a", 2), ("b", 3)]
