"""A star schema's tables (orders, customers, documents and so on) as a graph: foreign keys stay columns, so no edge table is built."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import Cardinality, DataType
from ..operators.store import TYPE, ForeignKey, Graph
from ..plans.catalog import Catalog, EntityDef, FieldDef, Model, RefDef

_I, _D, _S, _T, _B = DataType.INTEGER, DataType.DECIMAL, DataType.STRING, DataType.DATETIME, DataType.BOOLEAN
_ONE, _MANY = Cardinality.OPTIONAL, Cardinality.MANY


def _money(key: str) -> FieldDef:
    return FieldDef(key, _D, precision=18, scale=2)


def _pair(name: str, target: str, inverse: str) -> RefDef:
    return RefDef(name, target, inverse, _ONE, f"{name}_{inverse}", "a")


def _back(name: str, target: str, inverse: str) -> RefDef:
    return RefDef(name, target, inverse, _MANY, f"{inverse}_{name}", "b")


MODEL = Model(
    "Star",
    (
        EntityDef("Region", None, (FieldDef("Name", _S),), (_back("Nations", "Nation", "Region"),)),
        EntityDef("Nation", None, (FieldDef("Name", _S),), (_pair("Region", "Region", "Nations"), _back("Parties", "Party", "Nation"), _pair("Next", "Nation", "Previous"), _back("Previous", "Nation", "Next"))),
        EntityDef("Party", None, (FieldDef("Name", _S), _money("AcctBal")), (_pair("Nation", "Nation", "Parties"),)),
        EntityDef("Customer", "Party", (FieldDef("Segment", _S),), (_back("Orders", "Order", "Customer"), _back("Events", "Event", "User"))),
        EntityDef("Supplier", "Party", (), (_back("SupplierLines", "LineItem", "Supplier"),)),
        EntityDef("Part", None, (FieldDef("Name", _S), FieldDef("Brand", _S), FieldDef("Kind", _S), FieldDef("Size", _I), _money("RetailPrice")), (_back("PartLines", "LineItem", "Part"),)),
        EntityDef("Order", None, (FieldDef("Status", _S), _money("TotalPrice"), FieldDef("OrderDate", _T), FieldDef("Priority", _S)), (_pair("Customer", "Customer", "Orders"), _back("Lines", "LineItem", "Order"))),
        EntityDef("LineItem", None, (FieldDef("LineNumber", _I), FieldDef("Quantity", _I), FieldDef("ReturnFlag", _S), FieldDef("ShipDate", _T)), (_pair("Order", "Order", "Lines"), _pair("Part", "Part", "PartLines"), _pair("Supplier", "Supplier", "SupplierLines"))),
        EntityDef("Event", None, (FieldDef("At", _T), FieldDef("Kind", _S), _money("Value")), (_pair("User", "Customer", "Events"),)),
        EntityDef("Document", None, (FieldDef("Lang", _S), FieldDef("Source", _S), FieldDef("Chars", _I), FieldDef("Quality", _I), FieldDef("Toxic", _B)), (_pair("Parent", "Document", "Children"), _back("Children", "Document", "Parent"))),
        EntityDef("LabeledDocument", "Document"),
        EntityDef("ToxicDocument", "LabeledDocument"),
    ),
)

CATALOG = Catalog(MODEL)


def star(spark: SparkSession, path: str) -> Graph:
    """The graph over a folder of Parquet tables. Ids of suppliers are -1 - s_suppkey, so that they differ from customers'.

    Documents have type Document, LabeledDocument or ToxicDocument by their label; document n > 0 hangs below
    n div 2, and nation n is followed by (7 n + 3) mod 25, which goes round in circles. A line's id is a hash of its keys.
    """

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}.parquet")

    def long(name: str) -> Column:
        return F.col(name).cast("long")

    def money(name: str) -> Column:
        return F.col(name).cast("decimal(18,2)")

    labels = read("labels")
    documents = read("documents").join(labels, "doc_id", "left")
    kind = F.when(F.col("quality").isNull(), "Document").when(F.col("toxic") == 1, "ToxicDocument").otherwise("LabeledDocument")
    tables = {
        "Region": read("region").select(long("r_regionkey").alias("obj_id"), F.col("r_name").alias("Name")),
        "Nation": read("nation").select(long("n_nationkey").alias("obj_id"), F.col("n_name").alias("Name"), long("n_regionkey").alias("region"), ((long("n_nationkey") * 7 + 3) % 25).alias("next")),
        "Customer": read("customer").select(long("c_custkey").alias("obj_id"), F.col("c_name").alias("Name"), money("c_acctbal").alias("AcctBal"), F.col("c_mktsegment").alias("Segment"), long("c_nationkey").alias("nation")),
        "Supplier": read("supplier").select((-1 - long("s_suppkey")).alias("obj_id"), F.col("s_name").alias("Name"), money("s_acctbal").alias("AcctBal"), long("s_nationkey").alias("nation")),
        "Part": read("part").select(long("p_partkey").alias("obj_id"), F.col("p_name").alias("Name"), F.col("p_brand").alias("Brand"), F.col("p_type").alias("Kind"), long("p_size").alias("Size"), money("p_retailprice").alias("RetailPrice")),
        "Order": read("orders").select(long("o_orderkey").alias("obj_id"), F.col("o_orderstatus").alias("Status"), money("o_totalprice").alias("TotalPrice"), F.col("o_orderdate").alias("OrderDate"), F.col("o_orderpriority").alias("Priority"), long("o_custkey").alias("customer")),
        "LineItem": read("lineitem").select(F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("obj_id"), long("l_linenumber").alias("LineNumber"), long("l_quantity").alias("Quantity"), F.col("l_returnflag").alias("ReturnFlag"), F.col("l_shipdate").alias("ShipDate"), long("l_orderkey").alias("order"), long("l_partkey").alias("part"), (-1 - long("l_suppkey")).alias("supplier")),
        "Event": read("events").select(long("event_id").alias("obj_id"), F.col("ts").alias("At"), F.col("event_type").alias("Kind"), money("value").alias("Value"), long("user_id").alias("user")),
        "Document": documents.select(long("doc_id").alias("obj_id"), kind.alias(TYPE), F.col("lang").alias("Lang"), F.col("source").alias("Source"), long("n_chars").alias("Chars"), long("quality").alias("Quality"), F.when(F.col("toxic").isNotNull(), F.col("toxic") == 1).alias("Toxic"), F.when(F.col("doc_id") > 0, F.floor(F.col("doc_id") / 2)).cast("long").alias("parent")),
    }
    keys = {"Region_Nations": ("Nation", "region"), "Next_Previous": ("Nation", "next"), "Nation_Parties": ("Party", "nation"), "Customer_Orders": ("Order", "customer"), "Order_Lines": ("LineItem", "order"), "Part_PartLines": ("LineItem", "part"), "Supplier_SupplierLines": ("LineItem", "supplier"), "User_Events": ("Event", "user"), "Parent_Children": ("Document", "parent")}
    return Graph(CATALOG, tables, {n: ForeignKey(*k) for n, k in keys.items()})
