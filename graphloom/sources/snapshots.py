"""A graph at rest: Parquet tables in a folder of their own for each attempt to save, and a manifest that names them, put in place last by one rename.

A save that ends halfway leaves a folder that no manifest names, and can be made again. A
version's history is among its tables, so it holds no commit that the version doesn't have.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators.store import ForeignKey, Graph
from ..plans.catalog import Catalog


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    new, fs = _files(spark, path)
    if not fs.exists(new(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(new(path))]
    return sorted(int(n[1:-5]) for n in names if n[:1] == "v" and n[-5:] == ".json" and n[1:-5].isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{path}/v{version}.json", wholetext=True).first()[0])


def save(graph: Graph, path: str, history: DataFrame | None = None) -> int:
    """Write a new version, with the events that led to it; readers see it when its manifest is there. Returns its number.

    Of two saves at once one gets the number, and the other raises FileExistsError.
    """
    spark = next(iter(graph.tables.values())).sparkSession
    version = max(_versions(spark, path), default=0) + 1
    folder = f"data-{uuid.uuid4().hex}"
    at = f"{path}/{folder}"
    for key, table in graph.tables.items():
        table.write.parquet(f"{at}/tables/{key}")
    edges = {}
    for name, edge in graph.edges.items():
        edges[name] = [edge.entity, edge.column] if isinstance(edge, ForeignKey) else None
        if edges[name] is None:
            edge.write.parquet(f"{at}/edges/{name}")
    if history is not None:
        history.write.parquet(f"{at}/history")
    manifest = {"model": graph.catalog.model.id or graph.catalog.model.name, "folder": folder, "tables": list(graph.tables), "edges": edges, "history": history is not None}
    new, fs = _files(spark, path)
    out = fs.create(new(f"{at}/manifest.json"))
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if fs.exists(new(f"{path}/v{version}.json")) or not fs.rename(new(f"{at}/manifest.json"), new(f"{path}/v{version}.json")):
        raise FileExistsError(f"version {version} of {path} has been saved meanwhile")
    return version


def load(spark: SparkSession, path: str, catalog: Catalog, version: int | None = None) -> Graph:
    """A version of a graph, the last by default; its model must be the catalog's."""
    known = _versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no such version in {path}")
    manifest = _manifest(spark, path, known[-1] if version is None else version)
    at = f"{path}/{manifest['folder']}"
    if manifest["model"] != (catalog.model.id or catalog.model.name):
        raise ValueError(f"the graph's model is {manifest['model']}")
    tables = {k: spark.read.parquet(f"{at}/tables/{k}") for k in manifest["tables"]}
    edges = {n: ForeignKey(*e) if e else spark.read.parquet(f"{at}/edges/{n}") for n, e in manifest["edges"].items()}
    return Graph(catalog, tables, edges)


def history(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The events of all versions up to one, by default the last."""
    known = [_manifest(spark, path, v) for v in _versions(spark, path) if version is None or v <= version]
    parts = [spark.read.parquet(f"{path}/{m['folder']}/history") for m in known if m["history"]]
    if not parts:
        raise FileNotFoundError(f"no history in {path}")
    return reduce(DataFrame.unionByName, parts)
