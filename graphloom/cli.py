"""Command line: make, dump and load graphs, list their types and objects, create and change objects.

    python -m graphloom.cli --catalog package.module:NAME --path FOLDER db init|dump-json|load-json FILE | types | obj ...
"""

from __future__ import annotations

import argparse
import datetime as dt
import importlib
import sys
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.types import decode, encode
from .operators import history
from .operators.changes import Session
from .operators.store import TYPE, Graph
from .plans.catalog import Catalog
from .sources import json_dump, snapshots

WIDTH = 60


def table(headers: list[str], rows: list[list[str]]) -> str:
    """Columns as wide as their widest cell, at most WIDTH; longer cells end in an ellipsis."""
    shorten = lambda x: x if len(x) <= WIDTH else x[: WIDTH - 1] + "…"
    cells = [[shorten(str(c)) for c in r] for r in [headers, *rows]]
    widths = [max(len(r[k]) for r in cells) for k in range(len(headers))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths)).rstrip() for r in cells)


def list_objects(graph: Graph, entity: str, limit: int = 200) -> DataFrame:
    """obj_id, own and inherited fields and shortened references of objects of exactly this type, smallest ids first."""
    key = graph.catalog.entity(entity).key
    rows = graph.scan(key, exact=True).orderBy("obj_id").limit(limit)
    out = rows.select("obj_id", *graph.catalog.fields(key))
    for r in graph.catalog.refs(key):
        out = out.join(graph.collected(rows, key, r).withColumnRenamed("shown", r), "obj_id", "left")
    return out.orderBy("obj_id")


def show_object(graph: Graph, obj_id: str) -> Iterator[tuple[str, str]]:
    """Name and text of all fields of an object, and of its references one for each target with its type, every target; the driver holds one partition of them at a time."""
    found = graph.objects().where(F.col("obj_id") == obj_id).first()
    if found is None:
        raise SystemExit(f"no object {obj_id}")
    key = found[TYPE]
    row = graph.lookup(key, obj_id).first()
    yield "type", key
    for f in graph.catalog.fields(key).values():
        yield f.key, encode(row[f.key], f.type, f.variants)
    for r in graph.catalog.refs(key).values():
        far = graph.expand(graph.lookup(key, obj_id), key, r.key).join(graph.objects().withColumnRenamed("obj_id", "b"), "b")
        shown = False
        for x in far.orderBy("b").toLocalIterator():
            shown = True
            yield r.key, f"{x.b} ({x[TYPE]})"
        if not shown:
            yield r.key, ""


def assign(session: Session, entity: str, obj_id: str, pairs: list[str], add: bool = False) -> None:
    """Key=Value: an empty value clears; references take ids separated by commas, which replace or are added."""
    catalog = session.graph.catalog
    for pair in pairs:
        name, _, text = pair.partition("=")
        if name in catalog.refs(entity):
            if not add:
                session.unlink(entity, obj_id, name)
            for other in filter(None, map(str.strip, text.split(","))):
                session.link(entity, obj_id, name, other)
        else:
            f = catalog.field(entity, name)
            session.set(entity, obj_id, name, decode(text, f.type, f.variants))


def _commit(session: Session, entity: str, path: str, user: str) -> None:
    missing = session.missing_mandatory(entity).limit(5).collect()
    if missing:
        raise SystemExit("missing: " + ", ".join(f"{m.obj_id}.{m.ref}" for m in missing))
    events = history.commit_events(session.graph, session.rows(), history.CommitIds().next(), dt.datetime.now(), user)
    snapshots.save(session.apply(), path, events)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("--catalog", required=True)
    p.add_argument("--path", required=True)
    p.add_argument("--user", default="")
    sub = p.add_subparsers(dest="group", required=True)
    db = sub.add_parser("db")
    db.add_argument("action", choices=["init", "dump-json", "load-json"])
    db.add_argument("file", nargs="?")
    sub.add_parser("types")
    obj = sub.add_parser("obj")
    obj.add_argument("action", choices=["list", "show", "create", "update"])
    obj.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    obj.add_argument("--type")
    obj.add_argument("--id")
    obj.add_argument("--add", action="store_true")
    obj.add_argument("--limit", type=int, default=200)
    a = p.parse_args(args)
    module, _, name = a.catalog.partition(":")
    catalog: Catalog = getattr(importlib.import_module(module), name)
    spark = SparkSession.builder.getOrCreate()
    if a.group == "types":
        print(table(["key", "parent", "model"], [[r.key, r.parent or "", r.model] for r in catalog.to_frame(spark).collect()]))
        return 0
    if a.group == "db" and a.action != "dump-json":
        text = open(a.file, encoding="utf-8").read() if a.file else '{"entities": {}}'
        print(f"version {snapshots.save(json_dump.load(spark, text, catalog), a.path)}")
        return 0
    graph = snapshots.load(spark, a.path, catalog)
    if a.group == "db":
        text = json_dump.dump(graph)
        open(a.file, "w", encoding="utf-8").write(text) if a.file else print(text)
    elif a.action == "list":
        frame = list_objects(graph, a.type, a.limit)
        print(table(frame.columns, [["" if c is None else c for c in r] for r in frame.collect()]))
    elif a.action == "show":
        for name, value in show_object(graph, a.id):  # line by line and uncut, since there may be any number
            print(f"{name}: {value}".rstrip())
    else:
        session = Session(graph)
        obj_id = session.create(a.type, a.id) if a.action == "create" else a.id
        assign(session, a.type, obj_id, a.set, a.add)
        _commit(session, a.type, a.path, a.user)
        print(obj_id)
    return 0


if __name__ == "__main__":
    sys.exit(main())
