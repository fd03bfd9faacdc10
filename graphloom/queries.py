"""One query for each operator of the engine over the star graph, with the same in plain SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import changes, history
from .operators.paths import Paths
from .operators.search import gram_index, search
from .operators.store import TYPE, Graph
from .plans.criteria import Assoc, AssocMatch, Boolean, Criterion, ObjectId, Range, Text, TextMatch, Typed, all_of, any_of, one_of
from .sources import json_dump
from .sources.star import CATALOG, star

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _add(name: str, run: Callable[[Graph], DataFrame], sql: str | None) -> None:
    QUERIES[name] = lambda spark, path: run(star(spark, path))
    if sql:
        SQL[name] = sql


def _search(name: str, entity: str, criterion: Criterion | None, sql: str, columns: tuple[str, ...] = ("obj_id",), **options) -> None:
    _add(name, lambda g: search(g, entity, criterion, **options).select(*columns), sql)


def _path(name: str, source: str, sql: str, key: tuple[str, ...] = ("obj_id",), user=None, predicate: str = "P") -> None:
    _add(name, lambda g: Paths(g, source, user).holds(predicate).select(*key), sql)


# scalar criteria

_search("long_range", "Part", Range("Size", 10, 20), "SELECT p_partkey AS obj_id FROM part WHERE p_size BETWEEN 10 AND 20")
_search("long_range_default", "Document", Range("Quality", 0, 0), "SELECT doc_id AS obj_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 0) = 0")
_search("decimal_range", "Part", Range("RetailPrice", 950, 980), "SELECT p_partkey AS obj_id FROM part WHERE p_retailprice::DECIMAL(18,2) BETWEEN 950 AND 980")
_search("datetime_range", "Order", Range("OrderDate", dt.datetime(1996, 3, 1), dt.datetime(1996, 3, 31, 23, 59, 59, 999999)), "SELECT o_orderkey AS obj_id FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-31 23:59:59.999999'")
_search("bool_true", "Document", Boolean("Toxic", True), "SELECT doc_id AS obj_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1")
_search("bool_default_false", "Document", Boolean("Toxic", False), "SELECT doc_id AS obj_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0")
_search("str_exact", "Part", Text("Name", "RED PLATE", TextMatch.EXACT), "SELECT p_partkey AS obj_id FROM part WHERE lower(p_name) = 'red plate'")


def _blanked(g: Graph) -> Graph:
    return g.with_tables({"Part": g.tables["Part"].withColumn("Brand", F.when(F.col("Brand") != "Brand#11", F.col("Brand")))})


_add("str_exact_empty", lambda g: search(_blanked(g), "Part", Text("Brand", "", TextMatch.EXACT)).select("obj_id"), "SELECT p_partkey AS obj_id FROM part WHERE nullif(p_brand, 'Brand#11') IS NULL")
_search("str_prefix", "Part", Text("Name", "RED", TextMatch.PREFIX), "SELECT p_partkey AS obj_id FROM part WHERE starts_with(lower(p_name), 'red')")
_search("str_postfix", "Part", Text("Name", "Rod", TextMatch.POSTFIX), "SELECT p_partkey AS obj_id FROM part WHERE ends_with(lower(p_name), 'rod')")
_search("str_substring", "Part", Text("Name", "iDg"), "SELECT p_partkey AS obj_id FROM part WHERE contains(lower(p_name), 'idg')")
_TERM = "smal wigdet"
_HITS = " + ".join(f"contains(lower(p_name), '{_TERM[i:i + 3]}')::INT" for i in range(len(_TERM) - 2))
_search("str_fuzzy", "Part", Text("Name", _TERM, TextMatch.FUZZY, 0.4), f"SELECT p_partkey AS obj_id FROM part WHERE {_HITS} >= 4")
_search("id_lookup", "Order", ObjectId(7), "SELECT o_orderkey AS obj_id FROM orders WHERE o_orderkey = 7")

_add("gram_index", lambda g: gram_index(g, "Part", "Name").groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "SELECT gram, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, substr(lower(p_name), i, 3) AS gram FROM part, unnest(range(1, length(p_name) - 1)) AS r(i)) GROUP BY 1")

# combinations

_SMALL, _CHEAP, _RED = Range("Size", 1, 10), Range("RetailPrice", 0, 950), Text("Name", "red")
_PARTS = {"a": "p_size BETWEEN 1 AND 10", "b": "p_retailprice::DECIMAL(18,2) BETWEEN 0 AND 950", "c": "contains(lower(p_name), 'red')"}
_search("and_scalar", "Part", all_of(_SMALL, _CHEAP), f"SELECT p_partkey AS obj_id FROM part WHERE {_PARTS['a']} AND {_PARTS['b']}")
_search("or_scalar", "Part", any_of(_SMALL, _RED), f"SELECT p_partkey AS obj_id FROM part WHERE {_PARTS['a']} OR {_PARTS['c']}")
_search("xor_three", "Part", one_of(_SMALL, _CHEAP, _RED), f"SELECT p_partkey AS obj_id FROM part WHERE ({_PARTS['a']})::INT + ({_PARTS['b']})::INT + ({_PARTS['c']})::INT = 1")
_search("nested_multi", "Part", all_of(any_of(_SMALL, _RED), one_of(_CHEAP, _RED)), f"SELECT p_partkey AS obj_id FROM part WHERE ({_PARTS['a']} OR {_PARTS['c']}) AND ({_PARTS['b']})::INT + ({_PARTS['c']})::INT = 1")
_search("empty_multi", "Part", all_of(), "SELECT p_partkey AS obj_id FROM part WHERE false")
_search("limit_sorted", "Part", _SMALL, f"SELECT p_partkey AS obj_id FROM part WHERE {_PARTS['a']} ORDER BY 1 LIMIT 25", limit=25)

# associations

_DEAR = all_of(Text("Status", "F", TextMatch.EXACT), Range("TotalPrice", 200000, 10**9))
_DEAR_SQL = "o_orderstatus = 'F' AND o_totalprice::DECIMAL(18,2) >= 200000"
_search("assoc_subquery", "Customer", Assoc("Orders", _DEAR), f"SELECT c_custkey AS obj_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_DEAR_SQL})")
_search("assoc_subquery_bag", "Customer", Assoc("Orders", _DEAR), f"SELECT c_custkey AS obj_id FROM customer JOIN orders ON o_custkey = c_custkey WHERE {_DEAR_SQL}", multiplicity=True)
_search("assoc_null", "Order", Assoc("Lines", match=AssocMatch.NULL), "SELECT o_orderkey AS obj_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_search("assoc_notnull", "Order", Assoc("Lines", match=AssocMatch.NOT_NULL), "SELECT o_orderkey AS obj_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
_search("assoc_or_scalar", "Customer", any_of(Range("AcctBal", -(10**9), -1), Assoc("Orders", _DEAR)), f"SELECT c_custkey AS obj_id FROM customer WHERE c_acctbal::DECIMAL(18,2) <= -1 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_DEAR_SQL})")
_search("assoc_xor", "Customer", one_of(Range("AcctBal", 0, 10**9), Assoc("Orders", _DEAR), Assoc("Events", Text("Kind", "click", TextMatch.EXACT))), f"SELECT c_custkey AS obj_id FROM customer WHERE (c_acctbal::DECIMAL(18,2) >= 0)::INT + (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_DEAR_SQL}))::INT + (EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND lower(event_type) = 'click'))::INT = 1")
_search("assoc_and_assoc", "Customer", all_of(Assoc("Orders", _DEAR), Assoc("Events", Text("Kind", "click", TextMatch.EXACT))), f"SELECT c_custkey AS obj_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND {_DEAR_SQL}) AND EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND lower(event_type) = 'click')")
_search("assoc_nested", "Region", Assoc("Nations", Assoc("Parties", Typed("Customer", Text("Segment", "BUILDING", TextMatch.EXACT)))), "SELECT r_regionkey::BIGINT AS obj_id FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND lower(c_mktsegment) = 'building')")
_add("expand", lambda g: g.expand(search(g, "Part", Range("Size", 1, 3)), "Part", "PartLines").groupBy("a").agg(F.count(F.lit(1)).alias("n")), "SELECT p_partkey AS a, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size BETWEEN 1 AND 3 GROUP BY 1")
_add("single_target", lambda g: g.single(g.scan("Customer"), "Customer", "Orders"), "SELECT c_custkey AS obj_id, min(o_orderkey) AS target FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
_add("single_mandatory", lambda g: g.single(g.scan("Order"), "Order", "Lines", mandatory=True).select("obj_id"), "SELECT DISTINCT o_orderkey AS obj_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
_add("assoc_count", lambda g: g.degree(g.scan("Order"), "Order", "Lines"), "SELECT o_orderkey AS obj_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
_add("assoc_inverse", lambda g: g.expand(g.lookup("Nation", 3), "Nation", "Parties"), "SELECT 3::BIGINT AS a, b FROM (SELECT c_custkey AS b FROM customer WHERE c_nationkey = 3 UNION ALL SELECT -1 - s_suppkey FROM supplier WHERE s_nationkey = 3)")
_add("list_refs", lambda g: g.collected(g.scan("Customer"), "Customer", "Orders"), "WITH r AS (SELECT o_custkey AS c, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), s AS (SELECT c, string_agg(o::VARCHAR, ', ' ORDER BY k) FILTER (WHERE k <= 3) || CASE WHEN max(n) > 3 THEN ' and ' || (max(n) - 3)::VARCHAR || ' more' ELSE '' END AS shown FROM r GROUP BY c) SELECT c_custkey AS obj_id, coalesce(shown, '') AS shown FROM customer LEFT JOIN s ON c = c_custkey")

# types

_add("type_exact", lambda g: g.scan("Supplier", exact=True).select("obj_id", TYPE), "SELECT -1 - s_suppkey AS obj_id, 'Supplier' AS _typ FROM supplier")
_add("type_polymorphic", lambda g: g.scan("Party").select("obj_id", TYPE), "SELECT c_custkey AS obj_id, 'Customer' AS _typ FROM customer UNION ALL SELECT -1 - s_suppkey, 'Supplier' FROM supplier")
_search("type_base_field", "Party", Range("AcctBal", 5000, 10**9), "SELECT c_custkey AS obj_id FROM customer WHERE c_acctbal::DECIMAL(18,2) >= 5000 UNION ALL SELECT -1 - s_suppkey FROM supplier WHERE s_acctbal::DECIMAL(18,2) >= 5000")
_search("typed_subquery", "Party", any_of(Typed("Supplier"), Typed("Customer", Text("Segment", "auto", TextMatch.PREFIX))), "SELECT c_custkey AS obj_id FROM customer WHERE starts_with(lower(c_mktsegment), 'auto') UNION ALL SELECT -1 - s_suppkey FROM supplier")
_add("downcast", lambda g: g.downcast(search(g, "Document", Text("Lang", "en", TextMatch.EXACT)), "ToxicDocument").select("obj_id"), "SELECT doc_id AS obj_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND lang = 'en'")
_add("upcast", lambda g: g.upcast(g.scan("Customer"), "Party").select("obj_id", "Name"), "SELECT c_custkey AS obj_id, c_name AS \"Name\" FROM customer")
_add("object_scan", lambda g: g.objects().groupBy(TYPE).agg(F.count(F.lit(1)).alias("n")), "SELECT 'Region' AS _typ, count(*) AS n FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'LineItem', count(*) FROM lineitem UNION ALL SELECT 'Event', count(*) FROM events UNION ALL SELECT CASE WHEN quality IS NULL THEN 'Document' WHEN toxic = 1 THEN 'ToxicDocument' ELSE 'LabeledDocument' END, count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
_add("catalog_types", lambda g: g.catalog.to_frame(g.tables["Region"].sparkSession).select("key", "parent"), "SELECT * FROM (VALUES " + ", ".join(f"('{e.key}', {chr(39) + e.parent + chr(39) if e.parent else 'NULL'})" for e in CATALOG.entities.values()) + ") AS t(key, parent)")

# path predicates

_LINE = ("order", "part", "supplier", "LineNumber")
_LINE_SQL = "SELECT l_orderkey AS \"order\", l_partkey AS part, -1 - l_suppkey AS supplier, l_linenumber::BIGINT AS \"LineNumber\" FROM lineitem"
_path("path_one_step", 'P(Order): this->Customer[$.Segment="BUILDING"]', "SELECT o_orderkey AS obj_id FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
_path("path_multi_step", 'P(LineItem): this->Order[$.Status="F"]->Customer->Nation->Region[$.Name="ASIA"]', f"{_LINE_SQL} WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F' AND r_name = 'ASIA')", _LINE)
_path("path_roundtrip", 'P(Order): this->Customer->Orders[$.Status="P"]', "SELECT o.o_orderkey AS obj_id FROM orders o WHERE EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = o.o_custkey AND x.o_orderstatus = 'P')")
_path("path_no_filter", "P(Order): this->Lines->Part", "SELECT o_orderkey AS obj_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = o_orderkey)")
_path("path_neq_missing", "P(Document): this[$.Quality!=1]", "SELECT doc_id AS obj_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1")
_path("path_eq_missing", "P(Document): this[$.Quality=0]", "SELECT doc_id AS obj_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT DISTINCT FROM 0")
_path("path_bool", "P(Document): this[$.Toxic=false]", "SELECT doc_id AS obj_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 0")
_path("path_complex_filter", 'P(Order): this->Lines[$.ReturnFlag="R" AND ($.Quantity=10 OR $.LineNumber!=1)]', "SELECT o_orderkey AS obj_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND (l_quantity::BIGINT = 10 OR l_linenumber <> 1))")
_path("path_type_test", "P(Document): this->Children[$(ToxicDocument)]", "SELECT DISTINCT doc_id // 2 AS obj_id FROM documents JOIN labels USING (doc_id) WHERE doc_id > 0 AND toxic = 1")
_path("path_type_guard", "P(Document): this->Children[$(LabeledDocument).Quality=1]", "SELECT DISTINCT doc_id // 2 AS obj_id FROM documents JOIN labels USING (doc_id) WHERE doc_id > 0 AND quality = 1")
_path("path_narrowed_type", 'P(Nation): this->Parties[$(Customer) AND $.Segment="MACHINERY"]', "SELECT DISTINCT c_nationkey::BIGINT AS obj_id FROM customer WHERE c_mktsegment = 'MACHINERY'")
_path("path_current_user", "P(Event): this->User[$.CurrentUser=true]", "SELECT event_id AS obj_id FROM events WHERE user_id = 42", user=42)
_path("path_expr_and", 'P(Customer): this->Orders[$.Status="F"] AND this->Events[$.Kind="click"]', "SELECT c_custkey AS obj_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'click')")
_path("path_expr_or", 'P(Customer): this[$.Segment="BUILDING"] OR this->Events[$.Kind="click"]', "SELECT c_custkey AS obj_id FROM customer WHERE c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'click')")
_CALLS = 'Dear(Order): this[$.Status="F"]->Lines[$.Quantity=10] Fine(Customer): this->Orders[Dear($)=true] P(Event): this->User[Fine($)=true OR $.CurrentUser=true] AND this[$.Kind!="view"]'
_path("path_call", _CALLS, "SELECT event_id AS obj_id FROM events WHERE event_type <> 'view' AND (user_id = 42 OR EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = user_id AND o_orderstatus = 'F' AND l_quantity::BIGINT = 10))", user=42)
_path("path_rights", 'CanView(Customer): this[$.Segment="BUILDING"] P(Order): this->Customer[$.CanView=false]', "SELECT o_orderkey AS obj_id FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING'")
_TREE = "WITH RECURSIVE t AS (SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1), r AS (SELECT d.doc_id FROM documents d JOIN t ON d.doc_id // 2 = t.doc_id AND d.doc_id > 0 UNION SELECT d.doc_id FROM documents d JOIN r ON d.doc_id // 2 = r.doc_id AND d.doc_id > 0)"
_path("path_repeat_tree", "P(Document): this->repeat(->Parent)[$.Toxic=true]", f"{_TREE} SELECT doc_id AS obj_id FROM r")
_path("path_repeat_cycle", "P(Nation): this->repeat(->Next)->Region[$.Name=\"ASIA\"]", "WITH RECURSIVE e AS (SELECT n_nationkey AS n FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA'), r AS (SELECT x.n_nationkey AS n FROM nation x JOIN e ON (x.n_nationkey * 7 + 3) % 25 = e.n UNION SELECT x.n_nationkey FROM nation x JOIN r ON (x.n_nationkey * 7 + 3) % 25 = r.n) SELECT n::BIGINT AS obj_id FROM r")
_path("path_repeat_suffix", 'P(Document): this->repeat(->Parent)[$.Toxic=true]->Children[$.Lang="fr"]', _TREE.replace("WHERE toxic = 1)", "WHERE toxic = 1 AND EXISTS (SELECT 1 FROM documents c WHERE c.doc_id // 2 = documents.doc_id AND c.doc_id > 0 AND c.lang = 'fr'))") + " SELECT doc_id AS obj_id FROM r")

# changes and history


def _event_changes(g: Graph) -> DataFrame:
    e = g.tables["Event"]
    return e.select(F.col("user").alias("obj_id"), F.col("Kind").alias("fld_id"), F.col("obj_id").alias("seq"), F.col("Value").cast("string").alias("new_value"))


def _overlay(g: Graph) -> DataFrame:
    base = g.tables["Customer"].select("obj_id", "AcctBal")
    new = base.where("obj_id % 5 = 0").select("obj_id", (F.col("AcctBal") + 1).cast("decimal(18,2)").alias("AcctBal"), (F.col("obj_id") % 10 == 0).alias("deleted"))
    return changes.overlay(base, new, ["obj_id"]).select("obj_id", F.col("AcctBal").cast("double").alias("AcctBal"))


def _cascade(g: Graph) -> DataFrame:
    after = changes.delete_objects(g, "Customer", g.tables["Customer"].where("obj_id % 3 = 0"))
    kept = after.scan("Party").groupBy(TYPE).agg(F.count(F.lit(1)).alias("n"))
    links = after.links(CATALOG.ref("Order", "Customer")).agg(F.lit("Order_Customer").alias(TYPE), F.count(F.lit(1)).alias("n"))
    return kept.union(links)


def _event_history(g: Graph) -> DataFrame:
    base = g.tables["Customer"].select("obj_id", F.lit("click").alias("fld_id"), F.lit("0").alias("value"))
    return history.field_events(_event_changes(g), base).select("obj_id", "fld_id", "seq", "old_value", "new_value")


def _edges_both(g: Graph, orders: str = "true") -> DataFrame:
    """Edge events of the orders for which a condition holds, of all of them if there is none."""
    rows = g.tables["Order"].where(orders).select(F.col("obj_id").alias("obj_a"), F.lit("Customer").alias("fld_a"), F.col("customer").alias("obj_b"), F.lit("Orders").alias("fld_b"), F.col("obj_id").alias("seq"), (F.col("Status") != "F").alias("added"))
    return history.edge_events(rows)


def _log(g: Graph) -> DataFrame:
    e = g.tables["Event"]
    return e.select(F.dayofyear("At").cast("long").alias("commit_id"), F.col("user").alias("obj_id"), F.col("obj_id").alias("seq"), F.lit(history.CHANGED).alias("type"), F.col("Kind").alias("fld_id"), F.col("Value").cast("string").alias("new_value"), F.col("At").alias("ts"), F.lit("u").alias("user_id"))


_add("lww_changeset", lambda g: changes.last_write(_event_changes(g), ["obj_id", "fld_id"], ["seq"]), "SELECT user_id AS obj_id, event_type AS fld_id, event_id AS seq, value::DECIMAL(18,2)::VARCHAR AS new_value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
_add("overlay_read", _overlay, "SELECT c_custkey AS obj_id, (c_acctbal::DECIMAL(18,2) + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2)::DOUBLE AS \"AcctBal\" FROM customer WHERE c_custkey % 10 <> 0")
_add("overlay_range", lambda g: changes.seek(_overlay(g), "obj_id", 100, 50), "SELECT c_custkey AS obj_id, (c_acctbal::DECIMAL(18,2) + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2)::DOUBLE AS \"AcctBal\" FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey >= 100 ORDER BY 1 LIMIT 50")
_add("delete_cascade", _cascade, "SELECT 'Customer' AS _typ, count(*) AS n FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Order_Customer', count(*) FROM orders WHERE o_custkey % 3 <> 0")
_add("edge_changes", lambda g: changes.unlink(changes.link(g.links(CATALOG.ref("Order", "Customer")), g.links(CATALOG.ref("Order", "Customer")).where("a % 2 = 0")), g.tables["Customer"].where("obj_id % 4 = 0").select(F.col("obj_id").alias("b"))), "SELECT o_orderkey AS a, o_custkey AS b FROM orders WHERE o_custkey % 4 <> 0")
_add("history_events", _event_history, "WITH l AS (SELECT user_id AS obj_id, event_type AS fld_id, event_id AS seq, value::DECIMAL(18,2)::VARCHAR AS new_value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1) SELECT obj_id, fld_id, seq, CASE WHEN fld_id = 'click' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = obj_id) THEN '0' END AS old_value, new_value FROM l WHERE new_value IS DISTINCT FROM CASE WHEN fld_id = 'click' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey = obj_id) THEN '0' END")
# its SQL asks for every seventh order; history_edges_all is the whole job
_add("history_edges_both", lambda g: _edges_both(g, "obj_id % 7 = 0"), "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderstatus <> 'F' THEN 'AsoAdded' ELSE 'AsoRemoved' END AS t FROM orders WHERE o_orderkey % 7 = 0) SELECT k AS seq, t AS type, k AS obj_id, 'Customer' AS fld_id, c AS obj_b, 'Orders' AS fld_b FROM o UNION ALL SELECT k, t, c, 'Orders', k, 'Customer' FROM o")
_add("history_edges_all", _edges_both, "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CASE WHEN o_orderstatus <> 'F' THEN 'AsoAdded' ELSE 'AsoRemoved' END AS t FROM orders) SELECT k AS seq, t AS type, k AS obj_id, 'Customer' AS fld_id, c AS obj_b, 'Orders' AS fld_b FROM o UNION ALL SELECT k, t, c, 'Orders', k, 'Customer' FROM o")
_add("commits", lambda g: history.commits(_log(g), 20).select("commit_id", "n_events"), "SELECT dayofyear(ts) AS commit_id, count(*) AS n_events FROM events GROUP BY 1 ORDER BY 1 LIMIT 20")
_add("commits_for_object", lambda g: history.commits_of(_log(g), 42), "SELECT DISTINCT dayofyear(ts) AS commit_id FROM events WHERE user_id = 42")
_add("commit_by_id", lambda g: history.commit(_log(g), 10).select("obj_id", F.size("events").cast("long").alias("n"), F.col("events")[0].seq.alias("first")), "SELECT user_id AS obj_id, count(*) AS n, min(event_id) AS first FROM events WHERE dayofyear(ts) = 10 GROUP BY 1")
_add("history_as_of", lambda g: history.as_of(_log(g), 100), "SELECT user_id AS obj_id, event_type AS fld_id, value::DECIMAL(18,2)::VARCHAR AS value FROM events WHERE dayofyear(ts) <= 100 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY dayofyear(ts) DESC, event_id DESC) = 1")


def _with_text_ids(g: Graph) -> Graph:
    """The graph with text ids and its edges as tables, as sessions need it."""
    tables = {k: t.withColumn("obj_id", F.col("obj_id").cast("string")) for k, t in g.tables.items()}
    refs = {r.edge: r for e in g.catalog.entities.values() for r in e.refs if r.side == "a"}
    edges = {n: g.links(refs[n]).select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b")) for n in g.edges}
    return Graph(g.catalog, tables, edges)


def _session(graph: Graph) -> DataFrame:
    """A session's changes over three customers, as events of its commit."""
    s = changes.Session(graph)
    s.set("Customer", "7", "Segment", "FIRST")
    s.set("Customer", "7", "Segment", "LAST")
    s.set("Customer", "8", "Segment", None)
    s.create("Customer", "new", Name="N")
    s.delete("Customer", "9")
    events = history.commit_events(graph, s.rows(), 1, dt.datetime(2026, 1, 1), "u")
    return events.select("obj_id", "type", *[F.coalesce(c, F.lit("")).alias(c) for c in ("fld_id", "obj_b", "fld_b", "old_value", "new_value")])


# its SQL knows no edges; session_commit_edges is the whole job
_add("session_commit", lambda g: _session(Graph(g.catalog, {"Customer": _with_text_ids(g).tables["Customer"]}, {})).drop("obj_b", "fld_b"), "SELECT c_custkey::VARCHAR AS obj_id, 'FldChanged' AS type, 'Segment' AS fld_id, c_mktsegment AS old_value, CASE WHEN c_custkey = 7 THEN 'LAST' ELSE '' END AS new_value FROM customer WHERE c_custkey IN (7, 8) UNION ALL SELECT '9', 'ObjDeleted', '', '', '' UNION ALL SELECT 'new', 'ObjCreated', '', '', '' UNION ALL SELECT 'new', 'FldChanged', 'Name', '', 'N'")


_add("session_commit_edges", lambda g: _session(_with_text_ids(g)), """
WITH e AS (SELECT o_orderkey::VARCHAR AS a, 'Customer' AS fa, '9' AS b, 'Orders' AS fb FROM orders WHERE o_custkey = 9 UNION ALL SELECT event_id::VARCHAR, 'User', '9', 'Events' FROM events WHERE user_id = 9 UNION ALL SELECT '9', 'Nation', c_nationkey::VARCHAR, 'Parties' FROM customer WHERE c_custkey = 9)
SELECT c_custkey::VARCHAR AS obj_id, 'FldChanged' AS type, 'Segment' AS fld_id, '' AS obj_b, '' AS fld_b, c_mktsegment AS old_value, CASE WHEN c_custkey = 7 THEN 'LAST' ELSE '' END AS new_value FROM customer WHERE c_custkey IN (7, 8)
UNION ALL SELECT '9', 'ObjDeleted', '', '', '', '', '' UNION ALL SELECT 'new', 'ObjCreated', '', '', '', '', '' UNION ALL SELECT 'new', 'FldChanged', 'Name', '', '', '', 'N'
UNION ALL SELECT a, 'AsoRemoved', fa, b, fb, '', '' FROM e UNION ALL SELECT b, 'AsoRemoved', fb, a, fa, '', '' FROM e""")


# what a type can't hold, deletes in the log, unlinking all targets, objects made anew, new edges, and the rows that a cascade leaves

_search("long_range_between", "Part", Range("Size", 10.5, 12.5), "SELECT p_partkey AS obj_id FROM part WHERE p_size BETWEEN 10.5 AND 12.5")
_search("decimal_range_between", "Part", any_of(Range("RetailPrice", 950.001, 950.009), Range("RetailPrice", 899.999, 930.004)), "SELECT p_partkey AS obj_id FROM part WHERE p_retailprice::DECIMAL(18,2) BETWEEN 950.001 AND 950.009 OR p_retailprice::DECIMAL(18,2) BETWEEN 899.999 AND 930.004")
_path("path_number_between", "P(Part): this[$.RetailPrice=900.004 OR ($.Size=7 AND $.RetailPrice!=901.004)]->PartLines[$.Quantity=7]", "SELECT DISTINCT p_partkey AS obj_id FROM part JOIN lineitem ON l_partkey = p_partkey WHERE (p_retailprice::DECIMAL(18,2) = 900.004 OR p_size = 7 AND p_retailprice::DECIMAL(18,2) <> 901.004) AND l_quantity::BIGINT = 7")


def _log_with_deletes(g: Graph) -> DataFrame:
    gone = F.col("seq") % 5 == 0
    return _log(g).withColumns({"type": F.when(gone, history.DELETED).otherwise(F.col("type")), "fld_id": F.when(~gone, F.col("fld_id")), "new_value": F.when(~gone, F.col("new_value"))})


_add("history_as_of_deleted", lambda g: history.as_of(_log_with_deletes(g), 200), """
WITH e AS (SELECT *, dayofyear(ts) AS c FROM events WHERE dayofyear(ts) <= 200), d AS (SELECT user_id, max(c * 1000000000 + event_id) AS gone FROM e WHERE event_id % 5 = 0 GROUP BY 1),
l AS (SELECT * FROM e WHERE event_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY c DESC, event_id DESC) = 1)
SELECT user_id AS obj_id, event_type AS fld_id, value::DECIMAL(18,2)::VARCHAR AS value FROM l LEFT JOIN d USING (user_id) WHERE gone IS NULL OR c * 1000000000 + event_id > gone""")


def _unlinked(g: Graph) -> DataFrame:
    graph = _with_text_ids(g)
    s = changes.Session(graph)
    for k in range(1, 40):
        s.unlink("Customer", str(k), "Orders")
    s.link("Customer", "2", "Nation", "0")
    events = history.commit_events(graph, s.rows(), 1, dt.datetime(2026, 1, 1), "u")
    return events.select("obj_id", "type", "fld_id", "obj_b", "fld_b")


_add("session_unlink_all", _unlinked, """
WITH e AS (SELECT o_orderkey::VARCHAR AS a, o_custkey::VARCHAR AS b FROM orders WHERE o_custkey BETWEEN 1 AND 39), n AS (SELECT '2' AS a, '0' AS b WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = 2 AND c_nationkey = 0))
SELECT a AS obj_id, 'AsoRemoved' AS type, 'Customer' AS fld_id, b AS obj_b, 'Orders' AS fld_b FROM e UNION ALL SELECT b, 'AsoRemoved', 'Orders', a, 'Customer' FROM e
UNION ALL SELECT a, 'AsoAdded', 'Nation', b, 'Parties' FROM n UNION ALL SELECT b, 'AsoAdded', 'Parties', a, 'Nation' FROM n""")


def _recreated(g: Graph) -> DataFrame:
    s = changes.Session(_with_text_ids(g))
    s.delete("Customer", "9")
    s.create("Customer", "9", Name="again")
    s.set("Customer", "8", "Segment", "SET")
    after = s.apply()
    orders = after.degree(after.scan("Customer"), "Customer", "Orders")
    return after.tables["Customer"].join(orders, "obj_id").select("obj_id", "Name", "Segment", F.col("nation").alias("nation"), "n")


_add("session_recreate", _recreated, """
SELECT c_custkey::VARCHAR AS obj_id, CASE WHEN c_custkey = 9 THEN 'again' ELSE c_name END AS "Name", CASE c_custkey WHEN 9 THEN NULL WHEN 8 THEN 'SET' ELSE c_mktsegment END AS "Segment", CASE WHEN c_custkey <> 9 THEN c_nationkey::BIGINT END AS nation,
CASE WHEN c_custkey <> 9 THEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) ELSE 0 END AS n FROM customer""")


def _new_edges(g: Graph) -> DataFrame:
    """Every second order gets the customer behind its own as well; a fourth of the customers lose all."""
    links = g.links(CATALOG.ref("Order", "Customer"))
    more = links.where("a % 2 = 0").select("a", (F.col("b") + 1).alias("b"))
    return changes.unlink(changes.link(links, more), g.tables["Customer"].where("obj_id % 4 = 0").select(F.col("obj_id").alias("b")))


_add("edge_changes_new", _new_edges, "SELECT a, b FROM (SELECT o_orderkey AS a, o_custkey AS b FROM orders UNION SELECT o_orderkey, o_custkey + 1 FROM orders WHERE o_orderkey % 2 = 0) WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = b AND b % 4 = 0)")


def _cascade_rows(g: Graph) -> DataFrame:
    after = changes.delete_objects(g, "Customer", g.tables["Customer"].where("obj_id % 3 = 0"))
    kept = after.scan("Party").select(TYPE, "obj_id", F.lit(None).cast("long").alias("to"))
    return kept.union(after.scan("Order").select(F.lit("Order"), "obj_id", "customer")).union(after.scan("Event").select(F.lit("Event"), "obj_id", "user"))


_add("delete_cascade_rows", _cascade_rows, """
SELECT 'Customer' AS _typ, c_custkey AS obj_id, NULL::BIGINT AS "to" FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'Supplier', -1 - s_suppkey, NULL FROM supplier
UNION ALL SELECT 'Order', o_orderkey, CASE WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 = 0) THEN o_custkey END FROM orders
UNION ALL SELECT 'Event', event_id, CASE WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_custkey % 3 = 0) THEN user_id END FROM events""")


def _bulk_changes(g: Graph) -> DataFrame:
    """A change or two of every order, as rows: new priorities, every 7th goes, every 14th comes back empty, every 5th is copied and linked to the next customer."""
    o = g.tables["Order"].select("obj_id", F.col("customer").alias("c"))
    none = F.lit(None).cast("string")

    def some(where: str, step: int, op: str, obj=F.col("obj_id").cast("string"), field=none, value=none, other=none) -> DataFrame:
        return o.where(where).select((F.col("obj_id") * 10 + step).alias("seq"), F.lit(op).alias("op"), obj.alias("obj_id"), F.lit("Order").alias("typ"), field.alias("field"), value.alias("value"), other.alias("other"))

    copy = F.concat(F.lit("copy-"), F.col("obj_id").cast("string"))
    parts = [
        some("true", 0, "set", field=F.lit("Priority"), value=F.lit("first")), some("obj_id % 2 = 0", 1, "set", field=F.lit("Priority"), value=F.lit("last")),
        some("obj_id % 7 = 0", 2, "delete"), some("obj_id % 14 = 0", 3, "create"),
        some("obj_id % 5 = 0", 4, "create", copy), some("obj_id % 5 = 0", 5, "set", copy, F.lit("TotalPrice"), F.lit("1.50")), some("obj_id % 5 = 0", 6, "link", copy, F.lit("Customer"), other=(F.col("c") + 1).cast("string")),
    ]
    return reduce(DataFrame.union, parts)


def _bulk(g: Graph) -> DataFrame:
    """All orders after those changes, each with its customer by the edges."""
    graph = _with_text_ids(g)
    after = changes.apply_changes(graph, _bulk_changes(g))
    to = after.links(CATALOG.ref("Order", "Customer")).select(F.col("a").alias("obj_id"), F.col("b").alias("to"))
    return after.tables["Order"].join(to, "obj_id", "left").select("obj_id", "Status", F.col("TotalPrice").cast("double").alias("TotalPrice"), "Priority", "to")


_add("bulk_changes", _bulk, """
SELECT o_orderkey::VARCHAR AS obj_id, CASE WHEN o_orderkey % 14 <> 0 THEN o_orderstatus END AS "Status", CASE WHEN o_orderkey % 14 <> 0 THEN o_totalprice::DECIMAL(18,2)::DOUBLE END AS "TotalPrice",
CASE WHEN o_orderkey % 14 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'last' ELSE 'first' END AS "Priority", CASE WHEN o_orderkey % 14 <> 0 THEN o_custkey::VARCHAR END AS "to" FROM orders WHERE o_orderkey % 7 <> 0 OR o_orderkey % 14 = 0
UNION ALL SELECT 'copy-' || o_orderkey::VARCHAR, NULL, 1.5, NULL, (o_custkey + 1)::VARCHAR FROM orders WHERE o_orderkey % 5 = 0""")
_PLAIN = "Region Nation Party Part Order LineItem Event Document".split()
_add("catalog_lineage", lambda g: g.catalog.to_frame(g.tables["Region"].sparkSession).select("key", "parent"), "SELECT * FROM (VALUES " + ", ".join(f"('{k}', NULL)" for k in _PLAIN) + ", ('Customer', 'Party'), ('Supplier', 'Party'), ('LabeledDocument', 'Document'), ('ToxicDocument', 'LabeledDocument')) AS t(key, parent)")


def _loaded(g: Graph) -> DataFrame:
    """Regions, nations and parties, dumped as lines and loaded again: every field and every edge."""
    keys = ("Region", "Nation", "Customer", "Supplier")
    part = Graph(g.catalog, {k: g.tables[k] for k in keys}, {e: g.edges[e] for e in ("Region_Nations", "Nation_Parties")})
    back = json_dump.load(g.tables["Region"].sparkSession, json_dump.dump(part), g.catalog)
    party = back.scan("Party").select("obj_id", TYPE, "Name", F.col("AcctBal").cast("double").alias("AcctBal"), "Segment")
    to = back.links(CATALOG.ref("Party", "Nation")).withColumnRenamed("a", "obj_id")
    up = back.links(CATALOG.ref("Nation", "Region")).select(F.col("a").alias("b"), F.col("b").alias("region"))
    return party.join(to, "obj_id").join(up, "b").select("obj_id", TYPE, "Name", "AcctBal", "Segment", F.col("b").alias("nation"), "region")


_add("json_load", _loaded, """
WITH p AS (SELECT c_custkey AS k, 'Customer' AS t, c_name AS n, c_acctbal AS a, c_mktsegment AS s, c_nationkey AS c FROM customer UNION ALL SELECT -1 - s_suppkey, 'Supplier', s_name, s_acctbal, NULL, s_nationkey FROM supplier)
SELECT k::VARCHAR AS obj_id, t AS _typ, n AS "Name", a::DECIMAL(18,2)::DOUBLE AS "AcctBal", s AS "Segment", c::VARCHAR AS nation, n_regionkey::VARCHAR AS region FROM p JOIN nation ON n_nationkey = c""")


def _dumped(g: Graph) -> DataFrame:
    """The lines of Nation and Region, which the SQL asks for; json_dump_all is the whole job."""
    small = Graph(g.catalog, {"Nation": g.tables["Nation"], "Region": g.tables["Region"]}, {"Region_Nations": g.edges["Region_Nations"]})
    lines = json_dump.object_lines(small)
    return lines.select(F.get_json_object("json", "$['$type']").alias("typ"), F.get_json_object("json", "$.Name").alias("name"), F.get_json_object("json", "$.Region").alias("region"))


_add("json_dump", _dumped, "SELECT 'Nation' AS typ, n_name AS name, n_regionkey::VARCHAR AS region FROM nation UNION ALL SELECT 'Region', r_name, NULL FROM region")


def _dumped_all(g: Graph) -> DataFrame:
    """The lines of the whole graph: each object's type and id (a line's is a hash that SQL doesn't know), one target and the number of all that lists name."""
    lines = json_dump.object_lines(g)
    value = lambda k: F.get_json_object("json", f"$.{k}")
    kind = F.get_json_object("json", "$['$type']")
    lists = [F.coalesce(F.json_array_length(value(k)), F.lit(0)) for k in ("Nations", "Parties", "Previous", "Orders", "Events", "Lines", "PartLines", "SupplierLines", "Children")]
    one = F.coalesce(*map(value, ("Region", "Nation", "Customer", "Order", "User", "Parent")))
    return lines.select(kind.alias("typ"), F.when(kind != "LineItem", F.col("obj_id")).alias("obj_id"), value("Name").alias("name"), one.alias("one"), sum(lists).cast("long").alias("n"))


_add("json_dump_all", _dumped_all, """
WITH p AS (SELECT n_nationkey AS k, count(*) AS n FROM (SELECT c_nationkey AS n_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1),
b AS (SELECT (n_nationkey * 7 + 3) % 25 AS k, count(*) AS n FROM nation GROUP BY 1), r AS (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY 1),
o AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), e AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1), c AS (SELECT doc_id // 2 AS k, count(*) AS n FROM documents WHERE doc_id > 0 GROUP BY 1),
lo AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1), lp AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1), ls AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT 'Region' AS typ, r_regionkey::VARCHAR AS obj_id, r_name AS name, NULL::VARCHAR AS one, coalesce(r.n, 0)::BIGINT AS n FROM region LEFT JOIN r ON r.k = r_regionkey
UNION ALL SELECT 'Nation', n_nationkey::VARCHAR, n_name, n_regionkey::VARCHAR, coalesce(p.n, 0) + coalesce(b.n, 0) FROM nation LEFT JOIN p ON p.k = n_nationkey LEFT JOIN b ON b.k = n_nationkey
UNION ALL SELECT 'Customer', c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, coalesce(o.n, 0) + coalesce(e.n, 0) FROM customer LEFT JOIN o ON o.k = c_custkey LEFT JOIN e ON e.k = c_custkey
UNION ALL SELECT 'Supplier', (-1 - s_suppkey)::VARCHAR, s_name, s_nationkey::VARCHAR, coalesce(ls.n, 0) FROM supplier LEFT JOIN ls ON ls.k = s_suppkey
UNION ALL SELECT 'Part', p_partkey::VARCHAR, p_name, NULL, coalesce(lp.n, 0) FROM part LEFT JOIN lp ON lp.k = p_partkey
UNION ALL SELECT 'Order', o_orderkey::VARCHAR, NULL, o_custkey::VARCHAR, coalesce(lo.n, 0) FROM orders LEFT JOIN lo ON lo.k = o_orderkey
UNION ALL SELECT 'LineItem', NULL, NULL, l_orderkey::VARCHAR, 0 FROM lineitem
UNION ALL SELECT 'Event', event_id::VARCHAR, NULL, user_id::VARCHAR, 0 FROM events
UNION ALL SELECT CASE WHEN quality IS NULL THEN 'Document' WHEN toxic = 1 THEN 'ToxicDocument' ELSE 'LabeledDocument' END, doc_id::VARCHAR, NULL, CASE WHEN doc_id > 0 THEN (doc_id // 2)::VARCHAR END, coalesce(c.n, 0) FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN c ON c.k = doc_id""")


def flagship(spark: SparkSession, path: str) -> DataFrame:
    """Orders in a price range of customers in one market segment."""
    of_segment = Assoc("Customer", Text("Segment", "BUILDING", TextMatch.EXACT))
    return search(star(spark, path), "Order", all_of(Range("TotalPrice", 50000, 300000), of_segment)).select("obj_id", "Status", "TotalPrice")
