"""Relational tables as an object graph: a table is a class, a row an object, a foreign key a labelled edge from the owner to the owned."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sizes import Sizing
from ..plans.tables import HeapTables, checkpointed

SCALE = 10**12
#: Classes by code: name, loader, types of the fields.
CLASSES = {
    1: ("geo.Region", 1, ("int", "ref")),
    2: ("geo.Nation", 1, ("int", "ref", "ref", "ref")),
    3: ("trade.Customer", 2, ("long", "ref", "double", "ref", "ref")),
    4: ("trade.Supplier", 2, ("long", "ref", "double", "ref")),
    5: ("trade.Order", 2, ("long", "ref", "double", "long", "ref", "ref")),
    6: ("trade.order.LineItem", 3, ("long", "int", "double", "double", "double", "double", "ref", "ref", "long", "ref")),
    7: ("goods.Part", 3, ("long", "ref", "ref", "ref", "int", "double")),
}
SIZING = Sizing(16, 16, 8)


def shallow(code: int) -> int:
    """Bytes of an object of a class: header and fields, rounded up to 8."""
    fields = sum(SIZING.width(t) for t in CLASSES[code][2])
    return -(-(SIZING.header + fields) // 8) * 8


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ident(code: int, key) -> F.Column:
    return (F.lit(code * SCALE) + key.cast("long")).cast("long")


def line_items(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """obj, l_orderkey, l_suppkey, l_partkey of line items; of those of orders only, if given.

    The order's key and the line's number are not unique, so equal ones are numbered by their part and supplier. What is equal in these too
    has the same edges, so that no other column tells them apart, and none is shuffled. Written, as objects and edges are read off these rows.
    """
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    if orders is not None:
        items = items.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    by = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey")
    return checkpointed(items.select(ident(6, F.col("l_orderkey") * 10_000 + F.col("l_linenumber") * 100 + F.row_number().over(by)).alias("obj"), "l_orderkey", "l_suppkey", "l_partkey"))


def heap(spark: SparkSession, sf_dir: str, weak_suppliers: bool = False, root_regions: int | None = None, cycles: bool = False, until: str | None = None) -> HeapTables:
    """The graph of the tables. weak_suppliers: nations refer to suppliers weakly; root_regions: only regions of smaller keys are roots; cycles: orders refer back to customers; until: orders of a later date, and their items, are left out."""
    orders = read(spark, sf_dir, "orders")
    if until is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(until).cast("timestamp"))
    items = line_items(spark, sf_dir, None if until is None else orders)
    region, nation, customer, supplier, part = (read(spark, sf_dir, t) for t in ("region", "nation", "customer", "supplier", "part"))
    objects = [
        (1, region, F.col("r_regionkey")), (2, nation, F.col("n_nationkey")), (3, customer, F.col("c_custkey")), (4, supplier, F.col("s_suppkey")),
        (5, orders, F.col("o_orderkey")), (7, part, F.col("p_partkey")),
    ]
    union = lambda x: reduce(DataFrame.unionByName, x)
    row = lambda code, df, obj: df.select(obj.alias("obj"), F.lit(code).cast("long").alias("class_id"), F.lit("instance").alias("kind"), F.lit(0).cast("long").alias("len"), F.lit(shallow(code)).cast("long").alias("shallow"))
    rows = union([row(code, df, ident(code, key)) for code, df, key in objects] + [row(6, items, F.col("obj"))])
    # An edge's ord is the place among its source's; that of a foreign key is the owned key, as it orders them alike.
    edge = lambda df, src, dst, label, ord_: df.select(src.alias("src"), ord_.cast("long").alias("ord"), dst.alias("dst"), F.lit(label).alias("label"), F.lit(None).cast("long").alias("elem"))
    c = F.col
    strong = [
        edge(nation, ident(1, c("n_regionkey")), ident(2, c("n_nationkey")), "nations", c("n_nationkey")),
        edge(customer, ident(2, c("c_nationkey")), ident(3, c("c_custkey")), "customers", c("c_custkey")),
        edge(orders, ident(3, c("o_custkey")), ident(5, c("o_orderkey")), "orders", c("o_orderkey")),
        edge(items, ident(5, c("l_orderkey")), c("obj"), "items", c("obj")),
        edge(items, ident(4, c("l_suppkey")), c("obj"), "items", c("obj")),
        edge(items, c("obj"), ident(7, c("l_partkey")), "part", F.lit(0)),
    ]
    suppliers = edge(supplier, ident(2, c("s_nationkey")), ident(4, c("s_suppkey")), "suppliers", ident(1, c("s_suppkey")))
    weak = suppliers.select("src", "dst", F.lit("weak").alias("ref_kind"))
    if weak_suppliers:
        pass
    else:
        strong.append(suppliers)
        weak = weak.limit(0)
    if cycles:
        strong.append(edge(orders, ident(5, c("o_orderkey")), ident(3, c("o_custkey")), "customer", F.lit(0)))
    if root_regions is not None:
        region = region.where(c("r_regionkey") < root_regions)
    classes = spark.createDataFrame([(k, name, None, loader) for k, (name, loader, _) in CLASSES.items()], "class_id long, name string, super_id long, loader_id long")
    return HeapTables(classes, rows, union(strong), region.select(ident(1, c("r_regionkey")).alias("obj"), F.lit("system class").alias("kind")), weak)
