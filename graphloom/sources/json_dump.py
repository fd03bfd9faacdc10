"""JSON dumps: {"modelGuid", "importedModels"?, "entities": {id: {"$type", <field>: scalar, <ref>: id or [ids]}}}."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import Cardinality, DataType
from ..operators.store import TYPE, ForeignKey, Graph
from ..plans.catalog import Catalog, FieldDef

_OUTER = "modelGuid string, importedModels array<string>, entities map<string, string>"


def _scalar(f: FieldDef) -> Column:
    """A field from its JSON text (with quotes, if a string); of another JSON kind it is missing."""
    raw = F.col("v").getItem(f.key)
    quoted = raw.startswith('"')
    text = F.from_json(F.concat(F.lit('{"x":'), raw, F.lit("}")), "x string").getField("x")
    bare = F.when(~quoted, raw)
    if f.type is DataType.STRING:
        return F.when(quoted & (text != ""), text)
    if f.type is DataType.GUID:
        return F.when(quoted & (text != ""), F.lower(text))
    if f.type is DataType.DATETIME:
        return F.when(quoted, F.try_to_timestamp(text)).cast("timestamp_ntz")
    if f.type is DataType.ENUM:
        place = F.array_position(F.array(*[F.lit(v) for v in f.variants]).cast("array<string>"), text) - 1
        return F.when(quoted & (place >= 0), place.cast("int")).otherwise(bare.try_cast("int"))
    return bare.try_cast(f.spark)


def load(spark: SparkSession, text: DataFrame | str, catalog: Catalog) -> Graph:
    """The graph of a dump (JSON text, or a frame with one dump in each row of `value`).

    Keys that the catalog doesn't know, null values and values of another kind are left out. An edge that
    both ends name is one edge. Objects of unknown types are left out.
    """
    frame = spark.createDataFrame([(text,)], "value string") if isinstance(text, str) else text
    # the inner objects keep each value as JSON text, so that strings and numbers stay apart
    objects = frame.select(F.explode(F.from_json("value", _OUTER).getField("entities")).alias("obj_id", "raw"))
    objects = objects.select(F.lower("obj_id").alias("obj_id"), "raw", F.get_json_object("raw", "$['$type']").alias("t"))
    names = {x: k for k, e in catalog.entities.items() for x in (k, e.id) if x}
    types = F.create_map(*[F.lit(x) for p in names.items() for x in p])
    objects = objects.withColumn(TYPE, F.coalesce(types[F.col("t")], types[F.lower("t")])).where(F.col(TYPE).isNotNull())
    # a variant column tells kinds apart; its parts go back to JSON text
    objects = objects.withColumn("j", F.try_parse_json("raw"))
    tables, pairs = {}, []
    for key in catalog.entities:
        own = objects.where(F.col(TYPE) == key)
        fields, refs = catalog.fields(key), catalog.refs(key)
        parts = [F.lit(x) for f in (*fields, *refs) for x in (f,)]
        values = [F.to_json(F.try_variant_get("j", f"$.{f}", "variant")) for f in (*fields, *refs)]
        entry = F.map_from_arrays(F.array(*parts), F.array(*values)) if parts else F.create_map().cast("map<string,string>")
        rows = own.select("obj_id", entry.alias("v"))
        tables[key] = rows.select("obj_id", *[_scalar(f).cast(f.spark).alias(f.key) for f in fields.values()])
        for r in refs.values():
            raw = F.col("v").getItem(r.key)
            many = F.from_json(F.when(raw.startswith("["), raw).otherwise(F.concat(F.lit("["), raw, F.lit("]"))), "array<string>")
            far = rows.select("obj_id", F.explode(many).alias("o")).where(F.col("o").isNotNull())
            here, there = (F.col("obj_id"), F.lower("o")) if r.side == "a" else (F.lower("o"), F.col("obj_id"))
            pairs.append((r.edge, far.select(here.alias("a"), there.alias("b"))))
    edges: dict[str, DataFrame | ForeignKey] = {}
    for name in dict.fromkeys(n for n, _ in pairs):
        edges[name] = reduce(DataFrame.union, [p for n, p in pairs if n == name]).distinct()
    return Graph(catalog, tables, edges)


def _text(f: FieldDef) -> Column:
    c = F.col(f.key)
    if f.type is DataType.ENUM and f.variants:
        return F.try_element_at(F.array(*[F.lit(v) for v in f.variants]), c + 1)
    if f.type is DataType.DATETIME:
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return c


def object_lines(graph: Graph) -> DataFrame:
    """(obj_id, json) of every object, one line each: the form for graphs that don't fit one text. Missing values are left out."""
    parts = []
    for key in graph.tables:
        for kind in graph.catalog.descendants(key) if TYPE in graph.tables[key].columns else [key]:
            rows = graph.scan(kind, exact=True)
            fields = [f for f in graph.catalog.fields(kind).values() if f.key in rows.columns]
            out = rows.select(F.col("obj_id").cast("string").alias("obj_id"), F.lit(graph.catalog.entities[kind].id or kind).alias("$type"), *[_text(f).alias(f.key) for f in fields])
            columns = ["$type", *[f.key for f in fields]]
            for r in graph.catalog.refs(kind).values():
                if r.edge not in graph.edges:
                    continue
                links = graph.links(r).groupBy("a").agg(F.sort_array(F.collect_list(F.col("b").cast("string"))).alias("x")) if r.cardinality is Cardinality.MANY else graph.links(r).groupBy("a").agg(F.min(F.col("b").cast("string")).alias("x"))
                out = out.join(links.select(F.col("a").cast("string").alias("obj_id"), F.col("x").alias(r.key)), "obj_id", "left")
                columns.append(r.key)
            parts.append(out.select("obj_id", F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("json")))
    return reduce(DataFrame.unionAll, parts)


def dump(graph: Graph) -> str:
    """The whole graph as one text; it is gathered in the driver, so large graphs go through object_lines."""
    model = graph.catalog.model
    lines = object_lines(graph).orderBy("obj_id").collect()
    import json

    head = {"modelGuid": model.id or model.name} | ({"importedModels": list(model.imports)} if model.imports else {})
    body = ",".join(f"{json.dumps(r.obj_id)}:{r.json}" for r in lines)
    return json.dumps(head)[:-1] + ',"entities":{' + body + "}}"
